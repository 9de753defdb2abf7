"""Breadth-first search: hubs shared by tasks, pushing and pulling give the same levels."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from liveset.operators import graph as G


def plain(edges, seeds, max_depth):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    found, level = {s: (0, None) for s in seeds}, set(seeds)
    for depth in range(1, max_depth + 1):
        parents = defaultdict(set)
        for a in level:
            for b in after[a] - found.keys():
                parents[b].add(a)
        found.update({b: (depth, min(p)) for b, p in parents.items()})
        level = set(parents)
    return sorted((n, d, p) for n, (d, p) in found.items())


def hub_graph(seed):
    rng = random.Random(seed)
    loose = [(rng.randrange(400), rng.randrange(400)) for _ in range(500)]
    out = [(7, rng.randrange(2000)) for _ in range(600)]  # one node on half of all edges
    into = [(rng.randrange(400), 9) for _ in range(200)]
    return loose + out + into + [(1, 1), (2000, 2001)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hubs_and_directions_change_no_row(spark, seed):
    edges = hub_graph(seed)
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "source int, target int")
    start = spark.createDataFrame([(1,), (2001,), (5000,), (None,)], "node int")
    want = plain(edges, [1, 2001, 5000], 6)
    for hot, gain in ((10**9, 10**9), (20, 10**9), (20, 0.0), (20, 2.0)):
        got = G.bfs(df, start, 6, hot_rows=hot, pull_gain=gain).collect()
        assert sorted(map(tuple, got)) == want


def test_direction_follows_the_edge_counts(spark, monkeypatch):
    laid, links = [], G._Links
    monkeypatch.setattr(G, "_Links", lambda e, end, *rest: laid.append(end) or links(e, end, *rest))
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "source int, target int")
    seed = spark.createDataFrame([(0,)], "node int")
    assert G.bfs(chain, seed).count() == 6 and laid == ["source"]  # one edge a level: always pushed
    laid.clear()
    back = [(0, i) for i in range(1, 40)] + [(i, j) for i in range(1, 40) for j in range(0, 40)] + [(39, 99)]
    assert G.bfs(spark.createDataFrame(back, "source int, target int"), seed).count() == 41
    assert laid == ["source", "target"]  # 1,561 edges out of the level, one into the rest


def test_a_hub_is_shared_by_tasks(spark):
    df = spark.createDataFrame(hub_graph(3), "source int, target int").distinct()
    links = G._Links(df, "source", G.degrees(df, node="node"), 50)
    sizes = [r["count"] for r in links.edges.groupBy("source", "_salt").count().collect()]
    assert max(sizes) < 100 and sum(sizes) == df.count()
    assert links.of(spark.createDataFrame([(7,)], "node int")).count() == df.filter("source = 7").count()


def test_empty_graph_and_seeds(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert G.bfs(none, spark.createDataFrame([("a",)], "node string")).collect()[0].asDict() == {"node": "a", "depth": 0, "parent": None}
    some = none.union(spark.createDataFrame([("a", "b")], "source string, target string"))
    assert G.bfs(some, spark.createDataFrame([], "node string")).count() == 0
