"""Blocks of near vectors for a join of two large sides, and the pairs of blocks that matter.

Every vector belongs to its nearest pivot's cell. By the triangle inequality a question of a
cell with centre p and radius u lies at most d(p, c) + u + r from a row that is within r of
its own centre c, and at least d(p, c) - u - r. A pair of cells is left out when the second
exceeds what k rows are sure to keep within.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_PIVOTS = 256
ROUNDING = 1e-9  # far above the relative error of a directly computed distance


def pick_pivots(c: DataFrame, rows: int, wanted: int) -> np.ndarray:
    """At most ``wanted`` (never over ``MAX_PIVOTS``) different vectors, by the hash of the
    vector, each next one the farthest from those before it, so that the first few of them
    spread too. They decide which pairs can be left out, not what is found."""
    wanted = min(wanted, MAX_PIVOTS)
    place = F.xxhash64("v")
    thin = c.filter(F.pmod(place, F.lit(max(1, rows // (16 * wanted)))) == 0).select("v").distinct()
    got = thin.orderBy(F.xxhash64("v")).limit(wanted).collect() or c.select("v").limit(1).collect()
    x = np.array([r["v"] for r in got], dtype="float64")
    order, gap = [0], np.full(len(x), np.inf)
    while len(order) < len(x):
        gap = np.minimum(gap, ((x - x[order[-1]]) ** 2).sum(axis=1))
        gap[order] = -1.0
        order.append(int(gap.argmax()))
    return x[order]


def with_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``_cell``, the nearest pivot, and ``_away``, the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def nearest(vectors: pd.Series) -> pd.DataFrame:
        p, cell, away = shared.value, [], []
        for i in range(0, len(vectors), 1024):
            x = np.asarray(np.stack(list(vectors.iloc[i:i + 1024])), dtype="float64")
            at = ((p * p).sum(1)[None, :] - 2.0 * (x @ p.T)).argmin(axis=1)
            cell.append(at)
            away.append(np.sqrt(((x - p[at]) ** 2).sum(axis=1)))
        return pd.DataFrame({"cell": np.concatenate(cell).astype("int32"), "away": np.concatenate(away)}) if cell else pd.DataFrame(
            {"cell": np.zeros(0, "int32"), "away": np.zeros(0)})

    placed = F.pandas_udf(nearest, "cell int, away double")("v")
    return df.withColumn("_at", placed).select(*df.columns, F.col("_at.cell").alias("_cell"), F.col("_at.away").alias("_away"))


def cell_sizes(placed: DataFrame, cells: int, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, radius and radius of the ``k`` nearest rows of every cell; a row a cell is fetched."""
    n, far, close = np.zeros(cells, "int64"), np.zeros(cells), np.zeros(cells)
    for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_away").alias("far")).collect():
        n[r["_cell"]], far[r["_cell"]] = r["n"], r["far"]
    if k is not None:
        first = placed.select("_cell", "_away").withColumn("_r", F.row_number().over(W.partitionBy("_cell").orderBy("_away"))).filter(F.col("_r") <= k)
        for r in first.groupBy("_cell").agg(F.max("_away").alias("close")).collect():
            close[r["_cell"]] = r["close"]
    return n, far, close


def pairs_to_meet(q_pivots: np.ndarray, q_n: np.ndarray, q_far: np.ndarray, pivots: np.ndarray,
                  n: np.ndarray, far: np.ndarray, close: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Pairs (question cell, row cell) that can hold one of the ``k`` nearest."""
    pairs = []
    cells = np.flatnonzero(n)
    for i in np.flatnonzero(q_n):
        between = np.sqrt(((pivots[cells] - q_pivots[i]) ** 2).sum(axis=1))
        reach = between + q_far[i] + close[cells]
        by_reach = np.argsort(reach)
        sure = np.minimum(n[cells], k)[by_reach].cumsum()
        safe = reach[by_reach][np.searchsorted(sure, k)] if len(sure) and sure[-1] >= k else np.inf
        least = between - q_far[i] - far[cells]
        slack = ROUNDING * (between + q_far[i] + far[cells] + safe)
        # Written so that a distance that is not a number leaves nothing out.
        pairs += [(int(i), int(j)) for j in cells[~(least > safe + slack)]]
    return pairs
