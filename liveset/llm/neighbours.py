"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. Nodes are numbered block by block (``number >> 32`` is the block),
near ones in the same block as far as a few random splits, fitted on a bounded sample, tell.

* Start: nodes of a leaf of each of a few random-split trees are compared with each other.
* NN-descent round: a node's members are some of its neighbours and of the nodes it is a
  neighbour of, new ones first. Blocks ask each other, once a block, for the vectors of their
  nodes' members; every two members of a node are compared; pairs that improve a list travel to
  its block. Rounds end when few entries are new.
* Search: a query starts at nodes of its leaf and at scattered ones. In every hop blocks score
  the nodes they are asked for; the best ``beam`` nodes stay, and the neighbours of those that
  came in are asked for next, until nothing comes in.
* The best nodes are scored again from the original vectors, and stand for all their rows.

Everything a block sends is one row a receiving block; a block's size is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liveset.llm.common import mixed, partitions, written

#: Entries of a list; members from each side in a round; links back that a search follows.
NEIGHBOURS, SAMPLED, BACKWARD = 32, 16, 24
TREES, LEAF = 4, 2048
#: The trees' sample: rows and components at most, and rows of it a leaf at least.
SAMPLE_ROWS, SAMPLE_VALUES, LEAST_OF_LEAF = 1 << 15, 1 << 22, 8
#: Components of a block.
BLOCK_VALUES = 1 << 20
ROUNDS, SETTLED = 10, 0.1
BEAM, ENTRIES, SCORED_AGAIN = 192, 48, 48
HOPS = 100
CENTRES = 512
_LOW = (1 << 32) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part, repeated ones once."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    given = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine
    return vectors.filter(F.coalesce(given, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


# --- columns of bytes ----------------------------------------------------------------------------
def _blob(*values) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values]


def _get(table, column: str, kind, row: int = 0) -> np.ndarray:
    return np.frombuffer(table.column(column)[row].as_py(), kind)


def _rows(table, *columns):
    """All rows' bytes of some columns end to end, as arrays of the given kinds."""
    return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(c).to_pylist())]) for c, kind in columns]


def _matrix(lists, width: int, scale: float = 1.0) -> np.ndarray:
    """Vectors in single precision, filled with zeros; ``scale`` keeps them within its range."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.float32)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False) * scale
    return out


def _groups(key: np.ndarray):
    """Slices of a sorted key's equal runs."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return [(int(key[a]), slice(a, b)) for a, b in zip(at, np.append(at[1:], len(key)))]


def _first(key: np.ndarray, most: int) -> np.ndarray:
    """Marks the first ``most`` of every run of a sorted key."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key)))) < most


# --- random-split trees --------------------------------------------------------------------------
@dataclass
class Trees:
    """Per tree a direction and a border for every inner node, numbered as in a heap."""
    depth: int
    planes: np.ndarray  # trees, inner nodes, width
    borders: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, n: int) -> Trees:
        rng = np.random.default_rng(7)
        depth = 0
        while n >> depth > LEAF and len(sample) >> (depth + 1) >= LEAST_OF_LEAF:
            depth += 1
        planes = np.zeros((TREES, (1 << depth) - 1, sample.shape[1]), np.float32)
        borders = np.zeros((TREES, (1 << depth) - 1), np.float32)
        for t in range(TREES):
            groups = [np.arange(len(sample))]
            for node in range((1 << depth) - 1):
                rows = groups[node]
                a, b = rng.choice(rows, 2, replace=False)
                planes[t, node] = sample[a] - sample[b]
                at = sample[rows] @ planes[t, node]
                order = np.argsort(at, kind="stable")
                half = len(rows) // 2
                borders[t, node] = at[order[half]]
                groups += [rows[order[:half]], rows[order[half:]]]
        return Trees(depth, planes, borders)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), TREES), np.int64)
        for t in range(TREES):
            for lo in range(0, len(x), 4096):
                rows, node = x[lo:lo + 4096], np.zeros(len(x[lo:lo + 4096]), np.int64)
                for _ in range(self.depth):
                    right = np.einsum("ij,ij->i", rows, self.planes[t, node]) >= self.borders[t, node]
                    node = 2 * node + 1 + right
                out[lo:lo + 4096, t] = node - ((1 << self.depth) - 1)
        return out


def _with_leaves(trees: Trees, width: int, scale: float):
    def run(batches):
        for b in batches:
            leaves = trees.leaves(_matrix(b.column("v"), width, scale))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(leaves), pa.list_(pa.int64()))], names=[*b.schema.names, "leaves"])

    return run


# --- blocks ----------------------------------------------------------------------------------------
@dataclass
class Index:
    """``nodes``: number, v, ids. ``links``: block, x, links (numbers of linked nodes, -1 where
    there are fewer). ``entries``: first number and size of each leaf's place in the order."""
    nodes: DataFrame
    links: DataFrame
    trees: Trees
    entries: list[tuple[int, int]]
    width: int
    scale: float


def _with_cells(chunks: np.ndarray):
    """Nodes with the cells that they are compared in first: tree, leaf and share of the leaf."""
    def run(batches):
        for b in batches:
            number, leaves = b.column("number").to_numpy(), np.array(b.column("leaves").to_pylist(), np.int64).reshape(-1, TREES)
            tree = np.arange(TREES)
            share = mixed(number.astype(np.uint64)[:, None] + tree.astype(np.uint64)) % chunks[tree, leaves].astype(np.uint64)
            cells = (tree << 52) + (leaves << 32) + share.astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("number"), b.column("v"), pa.array(list(cells), pa.list_(pa.int64()))], names=["number", "v", "cells"])

    return run


def _stacked(width: int, scale: float):
    """A block's vectors as one row, in the order of their numbers."""
    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"), width, scale)[np.argsort(table.column("number").to_numpy())]
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), *_blob(x)], names=["block", "x"])

    return run


PAIRS = "block int, target binary, other binary, dist binary"


def _pairs(target: np.ndarray, other: np.ndarray, dist: np.ndarray, most: int) -> list:
    """Rows of ``PAIRS``: the ``most`` nearest of every target, one row a block."""
    order = np.lexsort((dist, other, target))
    target, other, dist = target[order], other[order], dist[order]
    new = np.append(True, (target[1:] != target[:-1]) | (other[1:] != other[:-1])) if len(target) else np.zeros(0, bool)
    target, other, dist = target[new], other[new], dist[new]
    order = np.lexsort((dist, target))
    order = order[_first(target[order], most)]
    target, other, dist = target[order], other[order], dist[order].astype(np.float32)
    return [[pa.array([block], pa.int32()), *_blob((target[s] & _LOW).astype(np.int32), other[s], dist[s])] for block, s in _groups(target >> 32)]


def _table(rows: list, names: list[str], types: list) -> pa.Table:
    empty = pa.table([pa.array([], t) for t in types], names=names)
    return pa.concat_tables([empty, *(pa.table(r, names=names) for r in rows)])


_PAIR_COLUMNS = (["block", "target", "other", "dist"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()])


def _cell_pairs(width: int):
    """The nearest nodes of every node within one cell."""
    most = NEIGHBOURS // 2

    def run(table: pa.Table) -> pa.Table:
        x, number = _matrix(table.column("v"), width), table.column("number").to_numpy()
        size, found = (x * x).sum(axis=1), []
        for lo in range(0, len(x) if len(x) > 1 else 0, CENTRES):
            d = size[lo:lo + CENTRES, None] + size[None] - 2 * (x[lo:lo + CENTRES] @ x.T)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            k = min(most, len(x) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            found.append((np.repeat(number[lo:lo + CENTRES], k), number[near].ravel(), np.maximum(np.take_along_axis(d, near, 1), 0).ravel()))
        if not found:
            return _table([], *_PAIR_COLUMNS)
        return _table(_pairs(*(np.concatenate(c) for c in zip(*found)), most), *_PAIR_COLUMNS)

    return run


# --- rounds -----------------------------------------------------------------------------------------
GRAPH = "block int, size int, fresh int, other binary, dist binary, worst binary, new binary"


def _lists(row: pa.Table):
    n = row.column("size")[0].as_py()
    return _get(row, "other", np.int64).reshape(n, NEIGHBOURS), _get(row, "new", bool).reshape(n, NEIGHBOURS)


def _graph_row(block: pa.Array, other: np.ndarray, dist: np.ndarray, new: np.ndarray) -> list[pa.Array]:
    return [block, pa.array([len(other)], pa.int32()), pa.array([new.sum()], pa.int32()), *_blob(other, dist, dist[:, -1], new)]


_GRAPH_COLUMNS = ["block", "size", "fresh", "other", "dist", "worst", "new"]


def _picked(other: np.ndarray, new: np.ndarray, most: int) -> np.ndarray:
    """Places of a node's members among its neighbours: new ones first, then near ones."""
    return np.argsort(np.where(other < 0, 2, np.where(new, 0, 1)), axis=1, kind="stable")[:, :most]


def _merged(graph: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's lists with better entries taken in; what was picked as a member is not new."""
    if not graph.num_rows:
        return graph
    other, new = _lists(graph)
    dist, new = _get(graph, "dist", np.float32).reshape(other.shape), new.copy()
    np.put_along_axis(new, _picked(other, new, SAMPLED), False, axis=1)
    n = len(other)
    have = other.ravel() >= 0
    target = np.repeat(np.arange(n), NEIGHBOURS)[have]
    t, o, d = _rows(pairs, ("target", np.int32), ("other", np.int64), ("dist", np.float32))
    target, fresh = np.concatenate([target, t]), np.concatenate([new.ravel()[have], np.ones(len(t), bool)])
    others, dists = np.concatenate([other.ravel()[have], o]), np.concatenate([dist.ravel()[have], d])
    order = np.lexsort((fresh, others, target))  # an entry that is there already stays as it is
    order = order[np.append(True, (target[order][1:] != target[order][:-1]) | (others[order][1:] != others[order][:-1]))] if len(order) else order
    order = order[np.lexsort((others[order], dists[order], target[order]))]
    order = order[_first(target[order], NEIGHBOURS)]
    row = target[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = (np.full((n, NEIGHBOURS), -1, np.int64), np.full((n, NEIGHBOURS), np.inf, np.float32), np.zeros((n, NEIGHBOURS), bool))
    for to, values in zip(out, (others, dists, fresh)):
        to[row, place] = values[order]
    return pa.table(_graph_row(graph.column("block").combine_chunks(), *out), names=_GRAPH_COLUMNS)


def _reversed(most: int, seed: int):
    """Edges of a block turned round, at most ``most`` a target and block, one row a target block."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = pa.Table.from_batches([b.slice(i, 1)])
                other, new = _lists(row)
                source = (np.int64(row.column("block")[0].as_py()) << 32) + np.repeat(np.arange(len(other)), NEIGHBOURS)
                have = other.ravel() >= 0
                source, target, new = source[have], other.ravel()[have], new.ravel()[have]
                order = np.lexsort((mixed(source.astype(np.uint64) * np.uint64(seed) + target.astype(np.uint64)), ~new, target))
                order = order[_first(target[order], most)]
                source, target, new = source[order], target[order], new[order]
                for block, s in _groups(target >> 32):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *_blob((target[s] & _LOW).astype(np.int32), source[s], new[s])],
                                                     names=["block", "target", "source", "new"])

    return run


def _members(forward: int, backward: int, seed: int):
    """Members of a block's nodes: some neighbours, and some that they are a neighbour of."""
    def run(graph: pa.Table, turned: pa.Table) -> pa.Table:
        names, types = ["block", "members", "new"], [pa.int32(), pa.binary(), pa.binary()]
        if not graph.num_rows:
            return _table([], names, types)
        other, new = _lists(graph)
        pick = _picked(other, new, forward)
        n = len(other)
        t, s, fresh = _rows(turned, ("target", np.int32), ("source", np.int64), ("new", bool))
        order = np.lexsort((mixed(s.astype(np.uint64) * np.uint64(seed) + t.astype(np.uint64)), ~fresh, t))
        order = order[_first(t[order], backward)]
        members, flags = np.full((n, forward + backward), -1, np.int64), np.zeros((n, forward + backward), bool)
        members[:, :pick.shape[1]], flags[:, :pick.shape[1]] = np.take_along_axis(other, pick, 1), np.take_along_axis(new, pick, 1)
        rows = t[order]
        members[rows, forward + np.arange(len(rows)) - np.searchsorted(rows, rows)] = s[order]
        flags[rows, forward + np.arange(len(rows)) - np.searchsorted(rows, rows)] = fresh[order]
        # A node met both ways is one member.
        by = np.argsort(members, axis=1, kind="stable")
        members, flags = np.take_along_axis(members, by, 1), np.take_along_axis(flags, by, 1)
        twice = np.zeros(members.shape, bool)
        twice[:, 1:] = members[:, 1:] == members[:, :-1]
        flags[:, :-1] |= flags[:, 1:] & twice[:, 1:]
        members[twice] = -1
        return pa.table([graph.column("block").combine_chunks(), *_blob(members, flags)], names=names)

    return run


def _asked(batches):
    """Which nodes' vectors a block needs: one row a block that has some."""
    for b in batches:
        for i in range(b.num_rows):
            number = np.unique(_get(b, "members", np.int64, i))
            number = number[number >= 0]
            for owner, s in _groups(number >> 32):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([owner], pa.int32()), pa.array([b.column("block")[i].as_py()], pa.int32()), *_blob((number[s] & _LOW).astype(np.int32))],
                    names=["owner", "asker", "place"])


def _sent(width: int):
    """Vectors asked for, as half-precision shares of their largest component, with that and
    the largest distance in each node's list."""
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if held.num_rows:
            x, worst = _get(held, "x", np.float32).reshape(-1, width), _get(held, "worst", np.float32)
            most = np.maximum(np.abs(x).max(axis=1), np.float32(1e-30))
            half = (x / most[:, None]).astype(np.float16)
            block = np.int64(held.column("block")[0].as_py()) << 32
            for i in range(asked.num_rows):
                place = _get(asked, "place", np.int32, i)
                rows.append([pa.array([asked.column("asker")[i].as_py()], pa.int32()), *_blob(block + place, half[place], most[place], worst[place])])
        return _table(rows, ["block", "number", "x", "most", "worst"], [pa.int32(), *[pa.binary()] * 4])

    return run


def _compared(width: int, places: int):
    """Every two members of a node compared; pairs nearer than the worst in a list."""
    def run(lists: pa.Table, sent: pa.Table) -> pa.Table:
        if not lists.num_rows or not sent.num_rows:
            return _table([], *_PAIR_COLUMNS)
        number, x, most, worst = _rows(sent, ("number", np.int64), ("x", np.float16), ("most", np.float32), ("worst", np.float32))
        x = x.reshape(-1, width).astype(np.float32) * most[:, None]
        order = np.argsort(number)
        number, x, worst = number[order], x[order], worst[order]
        size = (x * x).sum(axis=1)
        members, new = _get(lists, "members", np.int64).reshape(-1, places), _get(lists, "new", bool).reshape(-1, places)
        found = []
        for lo in range(0, len(members), CENTRES):
            m, fresh = members[lo:lo + CENTRES], new[lo:lo + CENTRES]
            at = np.searchsorted(number, np.maximum(m, number[0]))
            v = x[at]
            d = size[at][:, :, None] + size[at][:, None] - 2 * np.matmul(v, v.transpose(0, 2, 1))
            fits = (m >= 0)[:, :, None] & (m >= 0)[:, None] & (fresh[:, :, None] | fresh[:, None]) & (d < worst[at][:, :, None])
            fits[:, np.arange(places), np.arange(places)] = False
            g, a, b = np.nonzero(fits)
            found.append((number[at[g, a]], number[at[g, b]], np.maximum(d[g, a, b], 0)))
        return _table(_pairs(*(np.concatenate(c) for c in zip(*found)), NEIGHBOURS), *_PAIR_COLUMNS)

    return run


LISTS = "block int, members binary, new binary"


def _linked(graph: DataFrame, forward: int, backward: int, seed: int) -> DataFrame:
    turned = graph.select("block", "size", "other", "new").mapInArrow(_reversed(backward, seed), "block int, target binary, source binary, new binary")
    graph = graph.select(F.col("block").alias("block"), "size", "other", "new")
    return graph.groupBy("block").cogroup(turned.groupBy("block")).applyInArrow(_members(forward, backward, seed), LISTS)


def _round(graph: DataFrame, blocks: DataFrame, width: int, seed: int) -> DataFrame:
    lists = written(_linked(graph, SAMPLED, SAMPLED, seed), "members")
    asked = lists.mapInArrow(_asked, "owner int, asker int, place binary")
    held = blocks.join(graph.select(F.col("block").alias("b"), F.col("worst")), F.col("block") == F.col("b")).select("block", "x", "worst")
    sent = held.groupBy("block").cogroup(asked.groupBy("owner")).applyInArrow(_sent(width), "block int, number binary, x binary, most binary, worst binary")
    pairs = lists.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_compared(width, 2 * SAMPLED), PAIRS)
    before = graph.select(*[F.col(c).alias(c) for c in graph.columns])
    return written(before.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(_merged, GRAPH), "graph")


def _empty_lists(width: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                n = len(b.column("x")[i].as_py()) // (4 * width)
                shape = (n, NEIGHBOURS)
                yield pa.RecordBatch.from_arrays(_graph_row(
                    b.column("block").slice(i, 1), np.full(shape, -1, np.int64), np.full(shape, np.inf, np.float32), np.zeros(shape, bool)), names=_GRAPH_COLUMNS)

    return run


def build(vectors: DataFrame, copies: int = 11) -> Index | None:
    """Index of ``vectors`` (``vec_id``, ``embedding``); ``copies`` rows a vector are kept, the
    smallest ids. The trees are fitted on at most ``SAMPLE_ROWS`` vectors, chosen by hash; all
    vectors are nodes of the graph. ``None`` where no vector takes part."""
    rows = usable(vectors).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1))).dropDuplicates(["vec_id", "h1", "h2"])
    kept = rows.withColumn("place", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("place") <= copies)
    distinct = written(kept.groupBy("h1", "h2").agg(F.min_by("v", "vec_id").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    n, width, largest = distinct.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return None
    scale = 1.0 / largest
    some = distinct.orderBy("h1", "h2").limit(max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // width))).select("v")
    sample = np.zeros((0, width), np.float32) if n < 2 else _matrix(some.toArrow().column("v"), width, scale)
    trees = Trees.fit(sample, n)

    # Leaves in order fill blocks; a leaf beyond a block's size is dealt over blocks of its own.
    placed = written(distinct.mapInArrow(_with_leaves(trees, width, scale), "h1 long, h2 long, v array<double>, ids array<long>, leaves array<long>"), "placed")
    counts = np.zeros((TREES, 1 << trees.depth), np.int64)
    for tree, leaf, c in placed.select(F.posexplode("leaves")).groupBy("pos", "col").count().collect():  # TREES x leaves
        counts[tree, leaf] = c
    most = max(256, BLOCK_VALUES // width)
    first, shares, block, room = [], [], -1, 0
    for c in counts[0].tolist():
        share = max(1, -(-c // most))
        if share > 1 or c > room:
            block, room = block + 1, most if share == 1 else 0
        first.append(block)
        shares.append(share)
        block, room = block + share - 1, room - c if share == 1 else 0
    homes = distinct.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(zip(first, shares))], "leaf int, first int, share int")
    of_leaf = placed.withColumn("leaf", F.col("leaves")[0].cast("int")).join(F.broadcast(homes), "leaf")  # one row a leaf
    spread = of_leaf.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("h1", "h2"), F.col("share"))).cast("int"))
    number = F.shiftleft(F.col("block").cast("long"), 32) + F.row_number().over(W.partitionBy("block").orderBy("leaf", "h1", "h2")) - 1
    nodes = written(spread.withColumn("number", number).select("number", "block", "leaf", "leaves", "v", "ids"), "nodes")
    blocks = written(nodes.select("block", "number", "v").groupBy("block").applyInArrow(_stacked(width, scale), "block int, x binary"), "blocks")
    blocks = blocks.repartition(partitions(distinct.sparkSession), "block").persist()  # laid out once for all rounds
    ranges = nodes.groupBy("leaf", "block").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n"))
    entries = [tuple(r["e"]) for r in ranges.groupBy("leaf").agg(F.max(F.struct("n", "start")).alias("e")).collect()]  # one a leaf
    entries = sorted((start, size) for size, start in entries)

    chunks = np.maximum(1, -(-counts // (2 * LEAF)))
    dealt = nodes.select("number", "v", "leaves").mapInArrow(_with_cells(chunks), "number long, v array<double>, cells array<long>")
    dealt = dealt.select("number", F.transform("v", lambda x: (x * scale).cast("float")).alias("v"), F.explode("cells").alias("cell"))
    pairs = dealt.groupBy("cell").applyInArrow(_cell_pairs(width), PAIRS)
    empty = blocks.mapInArrow(_empty_lists(width), GRAPH)
    graph = written(empty.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(_merged, GRAPH), "graph")
    for step in range(ROUNDS):
        graph = _round(graph, blocks, width, 2 * step + 3)
        if graph.agg(F.sum("fresh")).first()[0] < SETTLED * n * NEIGHBOURS:
            break
    links = _linked(graph, NEIGHBOURS, BACKWARD, 1).select(F.col("block").alias("b"), F.col("members").alias("links"))
    links = written(blocks.join(links, F.col("block") == F.col("b")).select("block", "x", "links"), "links")
    blocks.unpersist()
    return Index(nodes.select("number", "v", "ids"), links, trees, entries, width, scale)


# --- search ------------------------------------------------------------------------------------------
STATE = "qkey long, q binary, number binary, dist binary, asked binary"


def _start(index: Index):
    trees, entries, width, scale = index.trees, index.entries, index.width, index.scale

    def run(batches):
        for b in batches:
            q, keys = _matrix(b.column("v"), width, scale), b.column("qkey").to_numpy()
            leaves = trees.leaves(q)[:, 0]
            starts = np.array([e[0] for e in entries], np.int64)
            sizes = np.array([e[1] for e in entries], np.int64)
            for i in range(len(q)):
                mix = mixed(np.uint64(keys[i] & (2**63 - 1)) + np.arange(ENTRIES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                # Two thirds in the query's own leaf, the rest anywhere; leaves are in order.
                leaf = np.where(np.arange(ENTRIES) % 3 < 2, min(int(leaves[i]), len(entries) - 1), (mix >> np.uint64(32)) % np.uint64(len(entries))).astype(np.int64)
                asked = np.unique(starts[leaf] + (mix & np.uint64(0xFFFFFFFF)).astype(np.int64) % sizes[leaf])
                yield pa.RecordBatch.from_arrays([pa.array([keys[i]]), *_blob(q[i], np.zeros(0, np.int64), np.zeros(0, np.float32), asked)],
                                                 names=["qkey", "q", "number", "dist", "asked"])

    return run


def _calls(beam: int):
    """What queries ask of blocks: nodes to score, and the distance that would still come in."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                asked, dist = _get(b, "asked", np.int64, i), _get(b, "dist", np.float32, i)
                bound = float(dist[-1]) if len(dist) >= beam else np.inf
                for block, s in _groups(asked >> 32):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block], pa.int32()), pa.array([b.column("qkey")[i].as_py()], pa.int64()), pa.array([b.column("q")[i].as_py()], pa.binary()),
                        pa.array([bound], pa.float32()), *_blob((asked[s] & _LOW).astype(np.int32))], names=["of_block", "qkey", "q", "bound", "place"])

    return run


def _answers(width: int, beam: int):
    """A block's nodes scored for the queries that ask, with the links of those that can stay."""
    def run(held: pa.Table, calls: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and calls.num_rows:
            x, links = _get(held, "x", np.float32).reshape(-1, width), _get(held, "links", np.int64).reshape(-1, NEIGHBOURS + BACKWARD)
            block = np.int64(held.column("block")[0].as_py()) << 32
            keys, bounds = calls.column("qkey").to_numpy(), calls.column("bound").to_numpy()
            for i in range(calls.num_rows):
                place, q = _get(calls, "place", np.int32, i), _get(calls, "q", np.float32, i)
                away = x[place] - q
                dist = np.einsum("ij,ij->i", away, away)
                stay = np.flatnonzero(dist < bounds[i])
                stay = stay[np.argsort(dist[stay], kind="stable")[:beam]]
                if len(stay):
                    place = place[stay]
                    some = links[place]
                    out.append((int(keys[i]), (block + place).tobytes(), dist[stay].astype(np.float32).tobytes(),
                                (some >= 0).sum(axis=1).astype(np.int32).tobytes(), some[some >= 0].tobytes()))
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int64() if j == 0 else pa.binary()) for j, c in enumerate(columns)],
                        names=["of_query", "number", "dist", "sizes", "links"])

    return run


def _kept(beam: int):
    """The best nodes of a query, and the neighbours to ask for of those that came in."""
    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        if not state.num_rows:
            return state
        number, dist = _get(state, "number", np.int64), _get(state, "dist", np.float32)
        more, near, sizes, links = _rows(answers, ("number", np.int64), ("dist", np.float32), ("sizes", np.int32), ("links", np.int64))
        cuts = np.append(0, np.cumsum(sizes))
        numbers, dists = np.concatenate([number, more]), np.concatenate([dist, near])
        source = np.append(np.full(len(number), -1), np.arange(len(more)))
        order = np.lexsort((source, numbers))
        order = order[np.append(True, numbers[order][1:] != numbers[order][:-1])] if len(order) else order
        order = order[np.lexsort((numbers[order], dists[order]))][:beam]
        came = source[order]
        asked = np.unique(np.concatenate([np.zeros(0, np.int64), *(links[cuts[j]:cuts[j + 1]] for j in came[came >= 0])]))
        asked = np.setdiff1d(asked, numbers, assume_unique=False)
        return pa.table([state.column("qkey").combine_chunks(), state.column("q").combine_chunks(), *_blob(numbers[order], dists[order], asked)],
                        names=["qkey", "q", "number", "dist", "asked"])

    return run


def _best(batches):
    for b in batches:
        for i in range(b.num_rows):
            number = _get(b, "number", np.int64, i)[:SCORED_AGAIN]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), b.column("qkey")[i].as_py(), np.int64)), pa.array(number)], names=["qkey", "number"])


def search(index: Index | None, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of every query.

    ``queries`` has ``query_id`` and ``v``; rows whose id is the query's are left out. ``score``
    is the Euclidean distance of the original vectors in double precision; equal ones go to the
    smaller id.
    """
    spark = queries.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    asked = queries.select("query_id", "v", F.xxhash64("query_id", "v").alias("qkey")).dropDuplicates(["query_id", "qkey"])
    asked = written(asked, "queries")
    # Laid out once: a hop sends questions and answers, not the index.
    held = index.links.repartition(partitions(spark), "block").persist()
    state = written(asked.select("qkey", "v").mapInArrow(_start(index), STATE), "state")
    for _ in range(HOPS):
        calls = state.mapInArrow(_calls(beam), "of_block int, qkey long, q binary, bound float, place binary")
        answers = held.groupBy("block").cogroup(calls.groupBy("of_block")).applyInArrow(
            _answers(index.width, beam), "of_query long, number binary, dist binary, sizes binary, links binary")
        state = written(state.groupBy("qkey").cogroup(answers.groupBy("of_query")).applyInArrow(_kept(beam), STATE), "state")
        if not state.filter(F.length("asked") > 0).limit(1).count():
            break
    held.unpersist()
    found = state.mapInArrow(_best, "qkey long, number long").join(index.nodes.withColumnRenamed("v", "x"), "number")
    scored = found.join(asked, "qkey")
    square = lambda total, d: total + d * d
    apart = F.zip_with("x", "v", lambda a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    scored = scored.select("query_id", "qkey", F.sqrt(F.aggregate(apart, F.lit(0.0), square)).alias("score"), F.explode("ids").alias("vec_id"))
    rank = W.partitionBy("query_id", "qkey").orderBy("score", "vec_id")
    best = scored.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``is_query`` (on ``vec_id``) holds for.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns, whatever their names, are
    ignored. Rows with a null id, a null or zero vector or a null or non-finite component take no
    part; of vectors of unlike lengths the shorter is filled with zeros. Rows repeated exactly
    count once; rows that share an id but differ are queries and candidates of their own, none of
    them for a query of that id. An empty table gives no rows.
    """
    index = build(vectors, copies=k + 1)
    queries = usable(vectors).filter(is_query).withColumnRenamed("vec_id", "query_id")
    return search(index, queries, k)
