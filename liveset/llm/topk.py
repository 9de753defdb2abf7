"""Exact top-k search by inner product with a three-phase uniform threshold.

A score is a sum over slices of the dimensions; each slice of each block of vectors keeps a
list of local scores, as a node of its own.

1. Every node sends its ``k`` best entries for each query, with their totals, and its
   smallest and largest local score. The k-th best of the totals is a bound no answer is below.
2. The bound, less the smallest scores, is shared out evenly: an answer must reach its share
   in some slice. The cutoffs and the largest scores travel with the queries.
3. Nodes are asked one after the other, those of large scores first, each only for the
   entries whose known scores plus the largest of the nodes not asked yet can still reach
   the bound. Of what is left,
   entries that reach a cutoff count; the ``k`` best of a block go out.

Queries and vectors meet as blocks of bounded size by an equi-join on their numbers. Lists
are cut to ``k`` entries, ties to the smaller id, before every shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCALE = 1024
SLICES = 2
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 8192, 512
EXACT = 2.0 ** 53
LONG = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` of the vectors without null or non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.coalesce(F.col("embedding").isNotNull() & fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Scaled and floored components, one row a vector; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    return out


def _widest(*columns) -> int:
    return max([1, *(int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns)])


class Block:
    """A block of queries against a block of vectors, slice by slice."""

    def __init__(self, queries: pa.Table, vectors: pa.Table):
        width = _widest(queries.column("qv"), vectors.column("v"))
        self.q, self.v = _matrix(queries.column("qv"), width), _matrix(vectors.column("v"), width)
        self.query_id = queries.column("query_id").to_numpy()
        ids = vectors.column("vec_id")
        self.null = ids.is_null().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.combine_chunks().is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        # Beyond this bound sums of doubles are no longer exact: whole numbers of any size then.
        self.wide = float(np.abs(self.q).max(initial=0)) * float(np.abs(self.v).max(initial=0)) * width >= EXACT
        self.cuts = [(s[0], s[-1] + 1) for s in np.array_split(np.arange(width), min(SLICES, width))]
        if self.wide:
            whole = np.vectorize(int, otypes=[object])
            self.q, self.v = whole(self.q), whole(self.v)
        self.order = np.lexsort((self.ids, self.null))  # ties: smaller id, null last
        self.v, self.ids, self.null = self.v[self.order], self.ids[self.order], self.null[self.order]

    def local(self, i: int, s: int, rows=slice(None)) -> np.ndarray:
        a, b = self.cuts[s]
        return self.v[rows, a:b] @ self.q[i, a:b]

    def others(self, i: int) -> np.ndarray:
        return self.null | (self.ids != self.query_id[i])

    @staticmethod
    def best(scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` highest, ties to the earlier place."""
        if len(scores) > 4 * k and scores.dtype != object:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            above, level = np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)
            return np.concatenate([above, level[:k - len(above)]])
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], j))[:k], np.int64)

    def ids_of(self, rows: np.ndarray) -> pa.Array:
        return pa.array(self.ids[rows], mask=self.null[rows])


def _longs(values) -> pa.Array:
    return pa.array([max(-LONG, min(LONG, int(x))) for x in values], pa.int64())


LISTS = "query_id long, qkey long, slice int, vec_id long, total long, low double, high double, wide boolean"
ENTRIES = "query_id long, qkey long, vec_id long, score long"


def _lists(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and vectors.num_rows:
            block = Block(queries, vectors)
            qkeys = queries.column("qkey").to_numpy()
            for i in range(len(block.q)):
                own = np.flatnonzero(block.others(i))
                if not len(own):
                    continue
                local = [block.local(i, s, own) for s in range(len(block.cuts))]
                total = sum(local)
                for s, scores in enumerate(local):
                    at = block.best(scores, k)
                    n = len(at)
                    parts.append(pa.table({
                        "query_id": np.full(n, block.query_id[i]), "qkey": np.full(n, qkeys[i]), "slice": np.full(n, s, np.int32),
                        "vec_id": block.ids_of(own[at]), "total": _longs(total[at]),
                        "low": np.full(n, float(scores.min())), "high": np.full(n, float(scores.max())), "wide": np.full(n, block.wide)}))
        empty = pa.table({n: pa.array([], t) for n, t in (
            ("query_id", pa.int64()), ("qkey", pa.int64()), ("slice", pa.int32()), ("vec_id", pa.int64()), ("total", pa.int64()),
            ("low", pa.float64()), ("high", pa.float64()), ("wide", pa.bool_()))})
        return pa.concat_tables([empty, *parts]).combine_chunks()

    return run


def _entries(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and vectors.num_rows:
            block = Block(queries, vectors)
            qkeys, wide = queries.column("qkey").to_numpy(), queries.column("wide").to_numpy(zero_copy_only=False)
            bounds, cutoffs, highs = (queries.column(c).to_pylist() for c in ("bound", "cutoffs", "highs"))
            for i in range(len(block.q)):
                own = np.flatnonzero(block.others(i))
                if wide[i] or block.wide or bounds[i] is None or cutoffs[i] is None or len(cutoffs[i]) != len(block.cuts):
                    total = sum(block.local(i, s, own) for s in range(len(block.cuts)))
                else:
                    total, reach = np.zeros(len(own)), np.zeros(len(own), bool)
                    order = sorted(range(len(highs[i])), key=lambda s: -highs[i][s])
                    for n, s in enumerate(order, 1):
                        scores = block.local(i, s, own)
                        total, reach = total + scores, reach | (scores >= cutoffs[i][s])
                        stay = np.flatnonzero(total + sum(highs[i][x] for x in order[n:]) >= bounds[i])
                        own, total, reach = own[stay], total[stay], reach[stay]
                    own, total = own[reach], total[reach]
                if not len(own):
                    continue
                at = block.best(total, k)
                n = len(at)
                parts.append(pa.table({"query_id": np.full(n, block.query_id[i]), "qkey": np.full(n, qkeys[i]),
                                       "vec_id": block.ids_of(own[at]), "score": _longs(total[at])}))
        empty = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "qkey", "vec_id", "score")})
        return pa.concat_tables([empty, *parts]).combine_chunks()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest score for every query.

    ``vectors`` has ``vec_id`` and ``embedding``, other columns are ignored; queries are the
    rows that ``is_query`` (a condition on ``vec_id``) holds for. Components are
    floor(1024 * x), scores their integer inner products; of vectors of unlike lengths the
    shorter is filled with zeros. Null vectors and ones with null or non-finite components
    take no part. All rows but those of the query's own ``vec_id`` are candidates, each row
    for itself; equal scores go to the smaller ``vec_id``, null last. A query row that is
    repeated exactly is one query; rows that differ under one id are ranked each alone.
    Scores beyond 64 bits are given as the nearest of them.
    """
    data = usable(vectors)
    queries = data.filter(is_query & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.xxhash64("vec_id", "v").alias("qkey")).dropDuplicates(["query_id", "qkey"])
    n_blocks = max(1, -(-data.count() // VECTORS_A_BLOCK))
    n_groups = max(1, -(-queries.count() // QUERIES_A_BLOCK))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("long")
    blocks = data.withColumn("block", number).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def against(q: DataFrame, run, schema: str) -> DataFrame:
        q = q.withColumn("group", F.pmod(F.xxhash64("qkey"), F.lit(n_groups)).cast("int"))
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        return q.groupBy("block", "group").cogroup(blocks.groupBy("block", "group")).applyInArrow(run, schema)

    lists = against(queries, _lists(k), LISTS)
    of_query = ["query_id", "qkey"]
    lows = lists.groupBy(*of_query, "slice").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # An entry may be in the list of every slice; it counts once towards the bound.
    entries = lists.groupBy(*of_query, "slice", "total", "vec_id").agg(F.max("wide").alias("wide"), F.count(F.lit(1)).alias("n"))
    entries = entries.groupBy(*of_query, "total", "vec_id").agg(F.max("wide").alias("wide"), F.max("n").alias("n"))
    rank = W.partitionBy(*of_query).orderBy(F.desc("total"), F.asc_nulls_last("vec_id"))
    reached = entries.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    bound = reached.groupBy(*of_query).agg(
        F.when(F.count(F.lit(1)) == k, F.min("total")).alias("bound"), F.max("wide").alias("wide"))
    shares = lows.groupBy(*of_query).agg(F.sort_array(F.collect_list(F.struct("slice", "low", "high"))).alias("lows"))  # one a slice
    shares = shares.join(bound, of_query).withColumn("share", (F.col("bound") - F.aggregate(
        "lows", F.lit(0.0), lambda a, x: a + x["low"])) / F.size("lows"))
    # A little above the largest score, for rounding beside blocks of very large components.
    highs = F.transform("lows", lambda x: x["high"] + F.abs(x["high"]) * 1e-9)
    cutoffs = shares.select(*of_query, "bound", "wide", F.transform("lows", lambda x: x["low"] + F.col("share") - 1e-3).alias("cutoffs"), highs.alias("highs"))
    final = against(queries.join(cutoffs, of_query, "left").withColumn("wide", F.coalesce("wide", F.lit(False))), _entries(k), ENTRIES)
    best = W.partitionBy(*of_query).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return final.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
