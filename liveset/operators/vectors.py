"""Embedding and exact nearest-neighbour search over question batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from liveset.operators.blocks import cell_sizes, pairs_to_meet, pick_pivots, with_cells
from liveset.operators.merge import top_per_key
from liveset.scale import checkpoint

# Questions sent to every task: at most this many vector components (64 MB of doubles).
MAX_BROADCAST_COMPONENTS = 8_000_000
MAX_BROADCAST_QUESTIONS = 20_000
GRID_ROWS = 20_000
QUESTION_SLICE = 512
BLOCK_ROWS = 8192


class HashingEncoder:
    """Deterministic bag-of-words vectors of unit length: a stand-in where no model is at
    hand. Words that agree bring texts together; meaning does not."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype="float32")
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, (h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, encoder: Callable[[Sequence[str]], np.ndarray] | None = None, text: str = "text",
          out: str = "embedding", batch: int = 64) -> DataFrame:
    """Add vectors of ``text``. Only the texts travel to Python, where the encoder gets
    ``batch`` of them at a time; it is shipped once and lives as long as its task."""
    encoder = encoder or HashingEncoder()

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            texts = column.fillna("").tolist()
            vectors: list = []
            for i in range(0, len(texts), batch):
                vectors.extend(np.asarray(encoder(texts[i:i + batch]), dtype="float32"))
            yield pd.Series(vectors, dtype="object")

    vector = F.pandas_udf(run, T.ArrayType(T.FloatType()))
    return df.withColumn(out, vector(text))


def refresh_vectors(corpus: DataFrame, vectors: DataFrame, encoder=None, key: str = "row_id") -> DataFrame:
    """Vectors of rows that have none yet; rows already embedded are not read again."""
    return embed(corpus.join(vectors.select(key), key, "left_anti"), encoder)


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """Exact squared-L2 ``k`` nearest rows of a block to every question.

    The product form picks candidates. Its rounding error grows with the squared norms and
    the dimension, and so does the margin: no row of the k nearest is left out at any norm.
    The candidates' distances are then computed directly, so equal vectors get equal ones.
    """
    if len(q_ids) > QUESTION_SLICE:
        return pd.concat([_nearest(q_ids[i:i + QUESTION_SLICE], q[i:i + QUESTION_SLICE], ids, c, k)
                          for i in range(0, len(q_ids), QUESTION_SLICE)])
    q_norm, c_norm = (q * q).sum(1)[:, None], (c * c).sum(1)[None, :]
    approx = q_norm + c_norm - 2.0 * (q @ c.T)
    if c.shape[0] > k:
        kth = np.partition(approx, k - 1, axis=1)[:, k - 1:k]
        error = 8 * np.finfo(np.float64).eps * (q.shape[1] + 4) * (q_norm + c_norm.max())
        qi, ci = np.nonzero(approx <= kth + 2 * error)
    else:
        qi, ci = np.divmod(np.arange(q.shape[0] * c.shape[0]), c.shape[0])
    found = pd.DataFrame({"question_id": q_ids[qi], "row_id": ids[ci], "score": ((c[ci] - q[qi]) ** 2).sum(axis=1)})
    return _keep(found, k)


def _keep(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["question_id", "score", "row_id"]).groupby("question_id", sort=False).head(k)


def _matrix(column) -> np.ndarray:
    return np.asarray(np.stack(list(column)), dtype="float64")


def knn(corpus: DataFrame, questions: DataFrame, k: int, row_id: str = "row_id", question_id: str = "question_id",
        vector: str = "embedding", max_questions: int = MAX_BROADCAST_QUESTIONS, grid_rows: int = GRID_ROWS) -> DataFrame:
    """Exact ``k`` nearest corpus rows per question by squared distance, ties by row id.

    Returns question_id, row_id, score, rank. A batch of questions within the bound goes
    to the tasks as one matrix: the corpus is scanned once, not shuffled, and every task
    returns ``k`` rows a question. A larger batch is met block by block (``_knn_grid``).
    """
    c = corpus.select(F.col(row_id).alias("row_id"), F.col(vector).alias("v")).filter("v is not null")
    q = questions.select(F.col(question_id).alias("question_id"), F.col(vector).alias("v")).filter("v is not null")
    schema = T.StructType([
        T.StructField("question_id", q.schema["question_id"].dataType),
        T.StructField("row_id", c.schema["row_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    asked = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("components")).first()
    if asked["n"] <= max_questions and asked["components"] <= MAX_BROADCAST_COMPONENTS:
        local = _knn_broadcast(c, q.collect(), k, schema)
    else:
        local = _knn_grid(c, q, k, schema, grid_rows)
    return top_per_key(local, ["question_id"], ["score", "row_id"], k)


def _knn_broadcast(c: DataFrame, rows: list, k: int, schema: T.StructType) -> DataFrame:
    if not rows:
        return c.sparkSession.createDataFrame([], schema)
    shared = c.sparkSession.sparkContext.broadcast(
        (np.array([r["question_id"] for r in rows]), np.array([r["v"] for r in rows], dtype="float64")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        best = None
        for pdf in frames:
            for i in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[i:i + BLOCK_ROWS]
                found = _nearest(q_ids, q, part["row_id"].to_numpy(), _matrix(part["v"]), k)
                best = found if best is None else _keep(pd.concat([best, found]), k)
        if best is not None:
            yield best

    return c.mapInPandas(run, schema)


def _knn_grid(c: DataFrame, q: DataFrame, k: int, schema: T.StructType, grid_rows: int) -> DataFrame:
    """Block join: both sides fall into the cells of pivots (``operators/blocks.py``), cells
    are cut into blocks of about ``grid_rows``, and a pair of blocks is one small task.

    Pairs of cells that cannot hold a near row are left out, and no row travels for them.
    Pivots are no more than blocks on either side, so where nothing can be left out a row is
    copied at most twice as often as without cells. Blocks of a cell are dealt by id and
    vector, so no cell, question or shared id makes a block hot; only rows equal in both go
    together.
    """
    spark, rows, asked = c.sparkSession, c.count(), q.count()
    if not rows or not asked:
        return spark.createDataFrame([], schema)
    pivots = pick_pivots(c, rows, -(-rows // grid_rows))
    q_pivots = pivots[:-(-asked // grid_rows)]
    c, q = checkpoint(with_cells(c, pivots)), checkpoint(with_cells(q, q_pivots))
    n, far, close = cell_sizes(c, len(pivots), k)
    q_n, q_far, _ = cell_sizes(q, len(q_pivots))
    blocks = lambda count: int(-(-count // grid_rows))
    met = [(i, j, blocks(q_n[i]), blocks(n[j])) for i, j in pairs_to_meet(q_pivots, q_n, q_far, pivots, n, far, close, k)]
    pairs = F.broadcast(spark.createDataFrame(met, "_qc int, _cc int, _qn int, _cn int"))  # MAX_PIVOTS squared at most
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    at = ["_cc", "_cb", "_qc", "_qb"]
    left = (
        c.withColumnRenamed("_cell", "_cc").join(pairs, "_cc")
        .withColumn("_cb", F.pmod(F.xxhash64("row_id", "v"), F.col("_cn")).cast("int")).withColumn("_qb", every("_qn"))
        .select(*at, "row_id", "v"))
    right = (
        q.withColumnRenamed("_cell", "_qc").join(pairs, "_qc")
        .withColumn("_qb", F.pmod(F.xxhash64("question_id"), F.col("_qn")).cast("int")).withColumn("_cb", every("_cn"))
        .select(*at, "question_id", "v"))

    def cell(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"question_id": [], "row_id": [], "score": []})
        q_ids, qm = asked["question_id"].to_numpy(), _matrix(asked["v"])
        ids, cm = rows["row_id"].to_numpy(), _matrix(rows["v"])
        return _nearest(q_ids, qm, ids, cm, k)

    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(cell, schema)


def knn_filtered(corpus: DataFrame, questions: DataFrame, k: int, condition: Column, overfetch: bool = False, **kw) -> DataFrame:
    """Nearest rows among those that meet ``condition``.

    Filtering comes first. With ``overfetch`` the nearest max(4k, 20) of all rows are
    taken and then filtered, which may return fewer.
    """
    if not overfetch:
        return knn(corpus.filter(condition), questions, k, **kw)
    row_id = kw.get("row_id", "row_id")
    wide = knn(corpus, questions, max(4 * k, 20), **kw).drop("rank")
    meets = corpus.filter(condition).select(F.col(row_id).alias("row_id"))
    return top_per_key(wide.join(meets, "row_id", "left_semi"), ["question_id"], ["score", "row_id"], k).select(
        "question_id", "row_id", "score", "rank")


def digest(corpus: DataFrame, prompts: DataFrame, k: int = 20, prompt_order: str = "question_id", **kw) -> DataFrame:
    """Rows near any of several prompts: each keeps its score for the first prompt that hit
    it; the ``k`` best of them."""
    hits = knn(corpus, prompts, k, question_id=prompt_order, **kw)
    first = hits.groupBy("row_id").agg(F.min_by(F.struct("question_id", "score"), "question_id").alias("h"))
    best = first.select("row_id", "h.question_id", "h.score").orderBy("score", "row_id").limit(k)
    # At most k rows are left, so one ordered window is safe.
    return best.withColumn("rank", F.row_number().over(W.orderBy("score", "row_id")))


def centroids(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key, combined component-wise before the shuffle."""
    parts = (
        vectors.select(key, F.posexplode(vector).alias("_i", "_x"))
        .groupBy(key, "_i").agg(F.avg("_x").alias("_x"))
    )
    ordered = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    return ordered.select(key, F.transform("_v", lambda s: s["_x"]).alias(vector))
