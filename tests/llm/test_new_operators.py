"""Phrases, hard negatives and nearest neighbours on small tables, against brute force: nulls,
empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from liveset.llm import collocations, neighbours, negatives
from liveset.llm.automata import Tree, compose, dictionary, union

CLASHES = ["part", "raw", "size", "grams", "n", "f", "score", "rank", "a", "l", "r", "whole_of", "asked_by", "_text", "v", "row_key", "block", "group",
           "anchor_id", "positives", "place", "h1", "h2", "ids", "leaves", "number", "query_id", "qkey", "q"]


def with_clashes(df):
    """Columns named like those that the operators make themselves, in another case too."""
    return df.select("*", *[F.lit(f"x{i}").alias(c if i % 2 else c.upper()) for i, c in enumerate(CLASHES)])


# --- automata --------------------------------------------------------------------------------
def random_rows(rng, n):
    rows = Counter(tuple(rng.choices(["a", "b", "cc", "é"], k=rng.randint(1, 4))) for _ in range(n))
    return dict(rows)


def tree_of(rows, depth=4):
    words, place = dictionary(pa.array([w.encode() for r in rows for w in r] or [b""], pa.binary()))
    ids, at = np.full((len(rows), depth), -1, np.int64), 0
    for i, r in enumerate(rows):
        ids[i, :len(r)] = place[at:at + len(r)]
        at += len(r)
    order = np.lexsort(ids.T[::-1])
    return Tree.of_sorted(words, ids[order], np.array(list(rows.values()), np.int64)[order])


def counts_of(tree):
    rows, counts = tree.rows()
    words = [w.decode() for w in tree.words.to_pylist()]
    return {tuple(words[i] for i in r if i >= 0): int(c) for r, c in zip(rows, counts)}


def weights_of(tree):
    words = [w.decode() for w in tree.words.to_pylist()]
    return {tuple(words[i] for i in p): int(w) for k, (_, weight, _) in enumerate(tree.layers)
            for p, w in zip(tree.paths(k, np.arange(len(weight))), weight)}


def test_automata_equal_counters():
    rng = random.Random(1)
    for _ in range(40):
        parts = [random_rows(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        trees = [tree_of(p) for p in parts]
        for rows, tree in zip(parts, trees):
            assert counts_of(tree) == rows
            raw, size = tree.pack()
            again = Tree.unpack(raw, size)
            assert counts_of(again) == rows and weights_of(again) == weights_of(tree)
        total = sum((Counter(p) for p in parts), Counter())
        merged = union(trees)
        assert counts_of(merged) == dict(total)
        prefix = Counter()
        for row, c in total.items():
            for k in range(1, len(row) + 1):
                prefix[row[:k]] += c
        assert weights_of(merged) == dict(prefix)
        asked = tree_of(random_rows(rng, 30))
        words = [w.decode() for w in asked.words.to_pylist()]
        for k, found in enumerate(compose(asked, merged)):
            for path, weight in zip(asked.paths(k, np.arange(len(found))), found):
                assert weight == prefix.get(tuple(words[i] for i in path), 0)


def test_equal_states_are_shared():
    rows = {(x, "b", "a"): 1 for x in ("a", "b", "cc")}
    raw = tree_of(rows, 3).pack()[1]
    apart = tree_of({(x, y, z): 1 for x, y, z in (("a", "b", "a"), ("b", "cc", "b"), ("cc", "a", "cc"))}, 3).pack()[1]
    assert raw < apart


# --- phrases -----------------------------------------------------------------------------------
def phrases_by_hand(rows, least, longest, first):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if any(y == lang and fx >= a and len(x) > len(w) and any(x[i:i + len(w)] == w for i in range(len(x))) for (y, x), fx in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:first], 1)}


def got_phrases(df, **kw):
    return {tuple(r) for r in collocations.collocations(df, **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(collocations, "ARCS", 50)  # ranges are united more than once
    rng = random.Random(seed)
    words = ["the", "The", "a", "dark", "star", "ünï", "\x01x", "it's", "(b)"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "? ", ";"]
    rows = [("".join(rng.choices(words, weights=[9, 3, 6, 4, 4, 2, 1, 2, 1])[0] + rng.choices(ends, weights=[20, 2, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "EN", None, "und", ""])) for _ in range(60)]
    rows += [(None, "en"), ("", "en"), (" \n ", None), ("dark star " * 40, "en"), ("dark star " * 40, "en")]
    df = with_clashes(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert got_phrases(df, least=3, longest=4, first=40) == phrases_by_hand(rows, 3, 4, 40)


def test_phrases_of_a_long_text_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 200)
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(["x", "y", "zz", "w."], k=4000)), "en"), ("y " * 500, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert {r[2:] for r in got_phrases(df, least=5, longest=3, first=100)} == {r[2:] for r in phrases_by_hand(rows, 5, 3, 100)}


def test_phrases_of_empty_tables_and_large_numbers(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert got_phrases(spark.createDataFrame([(None, None), ("a.b.c", "en")], "text string, lang string"), least=1) == set()
    score = collocations._scored(2)
    big = 10**15
    candidates = pa.table({"lang": ["en"], "phrase": ["a b"], "f": [big], "n": [4 * big]})
    parts = pa.table({"lang": ["en", "en"], "phrase": ["a", "b"], "f": [2 * big, 3 * big]})
    assert score(candidates, parts).column("score").to_pylist() == [1000 * big * 4 * big // (6 * big * big)]
    with pytest.raises(ValueError):
        collocations.phrase_counts(empty, least=300)


# --- vectors -------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, label int"


def vector_rows(seed, n=150, width=6):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=width), 2)], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(900, rows[0][1], 1), (901, rows[0][1], 1), (902, rows[0][1], 2), (903, rows[0][1], 2)]  # ties
    rows += [rows[5], rows[5], (200, [0.0] * width, 1), (201, [1.0], 2), (202, [], 3)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * width, 2), (303, [float("inf")] + [0.0] * (width - 1), 2),
             (None, [1.0] * width, 2), (304, rows[1][1], None)]
    return rows


def clean(rows, zero, label):
    out = {}
    for i, v, y in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (zero and not any(v)) or (label and y is None):
            continue
        out[i, tuple(v), y if label else 0] = True
    return list(out)


def negatives_by_hand(rows, every):
    data = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in clean(rows, False, True)]
    out = set()
    for i, a, y in data:
        if i % every:
            continue
        score = lambda v: sum(p * q for p, q in zip(a, v))  # noqa: B023, E731
        ranked = sorted(((-score(v), j, z) for j, v, z in data if j != i))
        for s, p, _ in [r for r in ranked if r[2] == y][:5]:
            fit = [(t, j) for t, j, z in ranked if z != y and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(i, p, n, j, -s, -t) for n, (t, j) in enumerate(fit[:10], 1)}
    return out


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 1e6), (3, 1e-3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, scale):
    monkeypatch.setattr(negatives, "FIRST_DEPTH", 4)  # lists are read in several steps
    monkeypatch.setattr(negatives, "ANCHORS_A_GROUP", 20)
    rows = [(i, v and [x and x * scale for x in v], y) for i, v, y in vector_rows(seed)]
    df = with_clashes(spark.createDataFrame(rows, VECTORS).repartition(5))
    got = {tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == negatives_by_hand(rows, 10)


def test_hard_negatives_stop_before_the_lists_end(monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4000, 2))
    table = pa.table({"vec_id": np.arange(4000), "label": np.zeros(4000, np.int64), "v": list(v)})
    anchor = pa.table({"anchor_id": [0], "row_key": [0], "label": [0], "v": [[1.0, -1.0]]})
    lists, scored = negatives.Lists(table, anchor), []
    clamped = lists._clamped
    monkeypatch.setattr(lists, "_clamped", lambda s: scored.append(len(s)) or clamped(s))
    ((at, scores),) = lists.best(0, np.ones(4000, bool), [(-negatives.LONG, negatives.LONG, 5)])
    exact = (np.floor(v * 256) @ np.array([256, -256])).astype(np.int64)
    assert sorted(scores, reverse=True) == sorted(exact, reverse=True)[:5] and sum(scored) < 1000


def test_hard_negatives_of_empty_and_lonely_rows(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).count() == 0
    lonely = spark.createDataFrame([(0, [1.0], 1), (1, [0.5], 2)], VECTORS)
    assert negatives.hard_negatives(lonely, F.col("vec_id") % 10 == 0).count() == 0


def nearest_by_hand(rows, every, k):
    data = clean(rows, True, False)
    width = max((len(v) for _, v, _ in data), default=0)
    data = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v, _ in data]
    out = {}
    for i, a in data:
        if i % every == 0:
            out.setdefault(i, []).append(sorted((round(float(np.sqrt(((a - v) ** 2).sum())), 9), j) for j, v in data if j != i)[:k])
    return out


def test_nearest_on_small_tables_is_exact(spark):
    rows = vector_rows(7)
    df = with_clashes(spark.createDataFrame(rows, VECTORS).repartition(5))
    want, got = nearest_by_hand(rows, 10, 10), {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"]))
    assert got == {i: x for i, (x,) in want.items() if x}
    assert neighbours.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.0, 0.0], 1)], VECTORS)
    assert [tuple(r) for r in neighbours.nearest(one, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]


def test_recall_of_graph_search(spark, monkeypatch):
    """Many leaves and blocks, several rounds; very unlike norms; a third of the rows one vector."""
    monkeypatch.setattr(neighbours, "LEAF", 64)
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 256 * 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8)) * 10.0 ** rng.integers(0, 3, 3000)[:, None]
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS).repartition(6)
    hit = total = 0
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(3000), d))[:10].tolist()) & found[q])
        total += 10
    assert hit / total >= 0.9


def test_rounds_improve_a_random_start(spark):
    """Lists that start with random nodes come close to the true neighbours."""
    rng = np.random.default_rng(5)
    n, width = 1200, 4
    x = rng.normal(size=(n, width)).astype(np.float32)
    k = neighbours.NEIGHBOURS
    other = np.stack([rng.choice(np.delete(np.arange(n), i), k, replace=False) for i in range(n)])
    dist = ((x[:, None] - x[other]) ** 2).sum(axis=2)
    by = np.argsort(dist, axis=1)
    other, dist = np.take_along_axis(other, by, 1).astype(np.int64), np.take_along_axis(dist, by, 1).astype(np.float32)
    row = pa.table(neighbours._graph_row(pa.array([0], pa.int32()), other, dist, np.ones((n, k), bool)), names=neighbours._GRAPH_COLUMNS)
    graph = spark.createDataFrame(row.to_pandas(), neighbours.GRAPH)
    blocks = spark.createDataFrame([(0, bytearray(x.tobytes()))], "block int, x binary")
    true = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 1:11]

    def recall(g):
        lists = np.frombuffer(g.first()["other"], np.int64).reshape(n, k)
        return np.mean([len(set(a) & set(b)) / 10 for a, b in zip(lists, true)])

    before = recall(graph)
    for step in range(6):
        graph = neighbours._round(graph, blocks, width, 2 * step + 3)
    assert before < 0.1 and recall(graph) > 0.9
