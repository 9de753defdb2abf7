"""Hard negatives by Fagin's threshold algorithm.

Vectors are dealt over blocks; every block sorts its components, one list a dimension. For an
anchor the lists are read from the end that its sign asks for, some depths at a time (sorted
access). Rows met for the first time are scored whole (random access). No row that is still
unmet can score more than the threshold, the anchor times the last components read; reading
stops once that is strictly below what each wanted list still needs.

1. Positives: the best rows of the anchor's label, of each block and then of all.
2. Negatives: every positive opens a window of scores; the best rows of other labels inside it,
   of each block and then of all.

Anchors and blocks meet by an equi-join on their numbers. A block's answer is a handful of rows
an anchor and window, whatever the block holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liveset.llm.common import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
VECTORS_A_BLOCK, ANCHORS_A_GROUP = 16384, 8192
LEAST_BLOCKS = 12  # also of a small table, so that tasks share it
FIRST_DEPTH = 64
LONG = 2**63 - 1
#: Whole numbers below these are exact in single and in double precision.
EXACT_SINGLE, EXACT_DOUBLE = 2.0 ** 24, 2.0 ** 53


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``v`` and ``row_key`` of the rows that take part, each once."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine
    rows = vectors.filter(F.coalesce(given, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("row_key", F.xxhash64("vec_id", "label", "v"))
    return rows.dropDuplicates(["vec_id", "row_key"])


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    return out


class Lists:
    """A block of vectors with one sorted list a dimension, read for one anchor at a time."""

    def __init__(self, vectors: pa.Table, anchors: pa.Table):
        v, a = (t.column("v").combine_chunks() for t in (vectors, anchors))
        width = max(1, *(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in (v, a)))
        self.v, self.a = _matrix(v, width), _matrix(a, width)
        self.ids, self.labels = (vectors.column(c).to_numpy() for c in ("vec_id", "label"))
        order = np.argsort(self.ids, kind="stable")  # ties: the smaller id comes first
        self.v, self.ids, self.labels = self.v[order], self.ids[order], self.labels[order]
        most = float(np.abs(self.v).max(initial=0)) * float(np.abs(self.a).max(initial=0)) * width
        self.wide = not most < EXACT_DOUBLE
        if self.wide:  # whole numbers of any size
            whole = np.vectorize(int, otypes=[object])
            self.v, self.a = whole(self.v), whole(self.a)
        elif most < EXACT_SINGLE:
            self.v, self.a = self.v.astype(np.float32), self.a.astype(np.float32)
        self.order = np.ascontiguousarray(np.argsort(self.v, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(self.v.T, self.order, axis=1)

    def _clamped(self, scores: np.ndarray) -> np.ndarray:
        if not self.wide:
            return scores.astype(np.int64)
        return np.array([max(-LONG, min(LONG, x)) for x in scores], object)

    def best(self, i: int, fits: np.ndarray, windows: list[tuple[int, int, int]]):
        """Per window (lowest score, highest score, how many) the places and scores of the best
        rows that ``fits`` marks, ties to the smaller id."""
        a, n = self.a[i], len(self.ids)
        down, up = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        met = np.zeros(n, bool)
        scores = np.zeros(n, object if self.wide else np.int64)
        scored = np.zeros(n, bool)
        depth, out = min(FIRST_DEPTH, n), {}
        read = 0
        while len(out) < len(windows):
            met[self.order[down, n - depth:n - read]] = True
            met[self.order[up, read:depth]] = True
            if depth == n:
                met[:] = True  # every list is read to its end, or the anchor is zero
            fresh = np.flatnonzero(met & ~scored)
            scores[fresh] = self._clamped(self.v[fresh] @ a)
            scored[fresh] = True
            last = np.concatenate([a[down] * self.sorted[down, n - depth], a[up] * self.sorted[up, depth - 1]])
            threshold = int(last.sum(dtype=None if self.wide else np.float64)) if len(last) else 0
            threshold = max(-LONG, min(LONG, threshold))
            places = np.flatnonzero(scored & fits)
            here = scores[places]
            for w, (low, high, k) in enumerate(windows):
                if w in out:
                    continue
                inside = np.flatnonzero((here <= high) & (here >= low))
                top = inside[np.argsort(-here[inside], kind="stable")[:k]]
                enough = int(here[top[-1]]) if len(top) == k else low
                if depth == n or threshold < enough:
                    out[w] = (places[top], here[top])
            read, depth = depth, min(4 * depth, n)
        return [out[w] for w in range(len(windows))]


def _lowest(score: int) -> int:
    """Smallest score with LOW * positive <= 100 * score."""
    return -(-LOW * score // 100)


def _highest(score: int) -> int:
    return HIGH * score // 100


FOUND = "anchor_id long, row_key long, place int, vec_id long, score long"


def _found(k: int, windows: bool):
    """Rows of a block for a group of anchors: positives, or negatives of the anchors' windows."""
    def run(anchors: pa.Table, vectors: pa.Table) -> pa.Table:
        parts = []
        if anchors.num_rows and vectors.num_rows:
            lists = Lists(vectors, anchors)
            keys, ids, labels = (anchors.column(c).to_numpy() for c in ("row_key", "anchor_id", "label"))
            opened = anchors.column("positives").to_pylist() if windows else [None] * len(ids)
            for i in range(len(ids)):
                if windows:
                    fits = (lists.labels != labels[i]) & (lists.ids != ids[i])
                    wanted = [(_lowest(p["score"]), _highest(p["score"]), k) for p in opened[i]]
                    places = [p["place"] for p in opened[i]]
                else:
                    fits, wanted, places = (lists.labels == labels[i]) & (lists.ids != ids[i]), [(-LONG, LONG, k)], [0]
                for place, (at, scores) in zip(places, lists.best(i, fits, wanted)):
                    parts.append((np.full(len(at), ids[i]), np.full(len(at), keys[i]), np.full(len(at), place, np.int32),
                                  lists.ids[at], scores.astype(np.int64)))
        names, kinds = ("anchor_id", "row_key", "place", "vec_id", "score"), (np.int64, np.int64, np.int32, np.int64, np.int64)
        return pa.table({c: np.concatenate([np.zeros(0, t), *(p[j] for p in parts)]) for j, (c, t) in enumerate(zip(names, kinds))})

    return run


def hard_negatives(vectors: DataFrame, is_anchor, label=None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; other columns, whatever their
    names, are ignored. ``is_anchor`` is a condition on ``vec_id``; ``label``, where given, an
    expression of ``vec_id`` and ``label`` that takes the label's place. Components are
    floor(256 * x), scores integer inner products; of vectors of unlike lengths the shorter is
    filled with zeros. Rows with a null id, label or vector or with a null or non-finite
    component take no part. Rows repeated exactly count once; rows that share an id but differ
    count each, and a row with the anchor's id is neither its positive nor its negative. Equal
    scores go to the smaller id. An anchor without positives, a positive without negatives and
    an empty table give no rows. Scores beyond 64 bits count as the nearest of them.
    """
    data = usable(vectors if label is None else vectors.withColumn("label", label))
    anchors = data.filter(is_anchor).select(*[F.col(c).alias(n) for c, n in (
        ("vec_id", "anchor_id"), ("row_key", "row_key"), ("label", "label"), ("v", "v"))])
    n_blocks = max(LEAST_BLOCKS, -(-data.count() // VECTORS_A_BLOCK))
    n_groups = max(1, -(-anchors.count() // ANCHORS_A_GROUP))
    blocks = data.withColumn("block", F.pmod(F.xxhash64("row_key", F.lit(1)), F.lit(n_blocks))).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def against(asked: DataFrame, run) -> DataFrame:
        asked = asked.withColumn("group", F.pmod(F.xxhash64("row_key", F.lit(2)), F.lit(n_groups)).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        return asked.groupBy("block", "group").cogroup(blocks.groupBy("block", "group")).applyInArrow(run, FOUND)

    of_anchor = ["anchor_id", "row_key"]
    place = W.partitionBy(*of_anchor).orderBy(F.desc("score"), "vec_id")
    near = against(anchors, _found(positives, False)).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= positives)
    near = written(near, "positives")  # used twice
    opened = near.groupBy(*of_anchor).agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    asked = anchors.join(opened, of_anchor)
    rank = W.partitionBy(*of_anchor, "place").orderBy(F.desc("score"), "vec_id")
    far = against(asked, _found(negatives, True)).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= negatives)
    pairs = near.select(*of_anchor, "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, [*of_anchor, "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
