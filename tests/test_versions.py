"""Multiset differences of versions and what follows from them, against counters."""

import random
from collections import Counter

import numpy as np
import pytest

from liveset.operators import versions as V


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "row_id string").repartition(4)


def changed(rows):
    return Counter((r["row_id"], r["change"]) for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_and_counts_equal_counters(spark, seed):
    rng = random.Random(seed)
    draw = lambda: [rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randint(0, 40))]
    versions = [draw(), draw(), draw()]
    counts = V.reference_counts(frame(spark, versions[0]), ["row_id"])
    for old, new in zip(versions, versions[1:]):
        diff = V.changes(frame(spark, old), frame(spark, new))
        a, b = Counter(old), Counter(new)
        want = Counter({(k, "added"): n for k, n in (b - a).items()}) + Counter({(k, "removed"): n for k, n in (a - b).items()})
        rows = diff.collect()
        assert changed(rows) == want
        for k in set(a) | set(b):
            assert sorted(r["occurrence"] for r in rows if r["row_id"] == k) == list(range(min(a[k], b[k]) + 1, max(a[k], b[k]) + 1))
        counts = V.fold_changes(counts, diff, ["row_id"])
        assert {r["row_id"]: r["n"] for r in counts.collect()} == dict(b)  # as a full recount
        total = V.totals(counts).first()
        assert (total["rows"], total["distinct_keys"]) == (len(new), len(b))


def test_kept_counts_do_not_read_the_versions(spark, tmp_path):
    base, kept = str(tmp_path / "base"), str(tmp_path / "kept")
    frame(spark, ["a", "a", "b"]).write.parquet(base)
    V.reference_counts(spark.read.parquet(base), ["row_id"]).write.parquet(kept)
    delta = spark.createDataFrame([("b", 1, "removed"), ("c", 1, "added"), ("c", 2, "added")], "row_id string, occurrence long, change string")
    folded = V.fold_changes(spark.read.parquet(kept), delta, ["row_id"])
    assert {r["row_id"]: r["n"] for r in folded.collect()} == {"a": 2, "c": 2}
    assert {f.rsplit("/", 2)[1] for f in folded.inputFiles()} == {"kept"}


def test_equal_rows_are_numbered(spark):
    rows = spark.createDataFrame([("x", i) for i in range(50)] + [("y", 1)], "row_id string, at int").repartition(5)
    for hot in (10, 10**6):
        got = sorted((r["row_id"], r["occurrence"], r["at"]) for r in V.numbered(rows, ["at"], hot_rows=hot).collect())
        assert got == [("x", i + 1, i) for i in range(50)] + [("y", 1, 1)]


def test_vectors_follow_their_rows(spark):
    def encoder(texts):
        return np.array([[float(len(t))] for t in texts])

    old = spark.createDataFrame([("a", "one"), ("a", "one"), ("b", "three"), ("c", "x")], "row_id string, text string")
    new = spark.createDataFrame([("a", "one"), ("c", "x"), ("d", "seven!!"), ("d", "seven!!")], "row_id string, text string")
    vectors = spark.createDataFrame([("a", [-1.0]), ("b", [-2.0]), ("c", [-3.0])], "row_id string, embedding array<float>")
    got = V.follow_vectors(vectors, V.reference_counts(old, ["row_id"]), V.changes(old, new), new, encoder)
    # One of two rows of ``a`` left: its vector stays. ``d`` came twice and is embedded once.
    assert sorted((r["row_id"], r["embedding"]) for r in got.collect()) == [("a", [-1.0]), ("c", [-3.0]), ("d", [7.0])]


def test_texts_that_vectors_follow_are_not_sorted(spark):
    def encoder(texts):
        return np.array([[float(len(t))] for t in texts])

    old = spark.createDataFrame([("a", "one"), ("b", "two"), (None, "none")], "row_id string, text string")
    new = spark.createDataFrame([("a", "one"), ("d", "seven!!"), ("d", "seven!!"), ("e", None), (None, "none")], "row_id string, text string")
    vectors = V.one_vector(spark.createDataFrame([("a", [-1.0]), ("a", [-1.0]), ("b", [-2.0])], "row_id string, embedding array<float>"))
    got = V.follow_vectors(vectors, V.reference_counts(old, ["row_id"]), V.changes(old, new), new, encoder)
    assert sorted((r["row_id"], r["embedding"]) for r in got.collect()) == [("a", [-1.0]), ("d", [7.0]), ("e", [0.0])]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    # Below the encoder there are texts: they stream past the hashed ids and are in no aggregate or sorted join.
    below = plan[plan.index("ArrowEvalPython"):].splitlines()[1:]
    assert "ShuffledHashJoin" in next(x for x in below if "Join" in x)
    assert not any("Aggregate" in x and "text#" in x for x in plan.splitlines())
