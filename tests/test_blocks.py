"""Block join of vectors: pairs of cells are left out, no near row is."""

import numpy as np
import pytest

from liveset.operators import blocks as B
from liveset.operators import vectors as V


def frame(spark, vectors, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{key} int, embedding array<double>").repartition(4)


def nearest(corpus, asked, k):
    d = ((corpus[None] - asked[:, None]) ** 2).sum(-1)
    return sorted((q, int(r), n + 1) for q in range(len(asked)) for n, r in enumerate(np.lexsort((np.arange(len(corpus)), d[q]))[:k]))


def clusters(seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=50.0, size=(8, 6))
    corpus = np.concatenate([c + rng.normal(size=(40, 6)) for c in centres] + [np.tile(centres[0], (160, 1))])  # a third are copies
    asked = np.concatenate([c + rng.normal(size=(6, 6)) for c in centres])
    return corpus * scale, asked * scale


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_blocks_are_skipped_and_rows_are_not(spark, monkeypatch, scale):
    corpus, asked = clusters(3, scale)
    met, meet = [], V.pairs_to_meet
    monkeypatch.setattr(V, "pairs_to_meet", lambda *a: met.append((meet(*a), (a[1] > 0).sum() * (a[4] > 0).sum())) or met[-1][0])
    found = V.knn(frame(spark, corpus, "row_id"), frame(spark, asked, "question_id"), 7, max_questions=1, grid_rows=6)
    assert sorted((r.question_id, r.row_id, r["rank"]) for r in found.collect()) == nearest(corpus, asked, 7)
    kept, possible = met[0]
    assert len(kept) < possible / 2


def test_more_wanted_than_a_cell_holds(spark):
    corpus, asked = clusters(4)
    found = V.knn(frame(spark, corpus[:30], "row_id"), frame(spark, asked[:9], "question_id"), 40, max_questions=1, grid_rows=4)
    assert sorted((r.question_id, r.row_id, r["rank"]) for r in found.collect()) == nearest(corpus[:30], asked[:9], 40)


def test_pairs_hold_every_near_row():
    rng = np.random.default_rng(8)
    for k in (1, 5, 30):
        corpus, asked = rng.normal(size=(200, 3)) ** 3, rng.normal(size=(40, 3)) ** 3
        pivots, q_pivots = corpus[:12], corpus[:5]
        place = lambda x, p: np.sqrt(((x[:, None] - p[None]) ** 2).sum(-1))
        dc, dq = place(corpus, pivots), place(asked, q_pivots)
        cc, qc = dc.argmin(1), dq.argmin(1)
        sizes = lambda d, cell, p: tuple(np.array(x) for x in zip(*[
            ((cell == j).sum(), max(d[cell == j, j], default=0), max(sorted(d[cell == j, j])[:k], default=0)) for j in range(p)]))
        n, far, close = sizes(dc, cc, 12)
        q_n, q_far, _ = sizes(dq, qc, 5)
        pairs = set(B.pairs_to_meet(q_pivots, q_n, q_far, pivots, n, far, close, k))
        for q, r, _ in nearest(corpus, asked, k):
            assert (qc[q], cc[r]) in pairs
    assert B.pairs_to_meet(q_pivots, q_n, q_far * np.nan, pivots, n, far, close, 1)[-1] == (int(np.flatnonzero(q_n)[-1]), 11)


def test_empty_sides_and_equal_rows(spark):
    same = frame(spark, np.ones((50, 4)), "row_id")
    asked = frame(spark, np.ones((5, 4)), "question_id")
    found = V.knn(same, asked, 3, max_questions=1, grid_rows=8).collect()
    assert sorted((r.question_id, r.row_id, r.score) for r in found) == [(q, r, 0.0) for q in range(5) for r in range(3)]
    assert V.knn(same.limit(0), asked, 3, max_questions=1).count() == 0
