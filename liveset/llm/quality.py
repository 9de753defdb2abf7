"""Quality scores from random Fourier features of document statistics.

Statistics of the whole text (lengths, kinds of characters, repetition of words, pairs and
lines, entropies) are scaled and mapped to cosine features, whose inner products
approximate a Gaussian kernel. Ridge regression on them needs only the sums of their
products: each task sums its labelled rows' normal equations, the sums are added by row of
the matrix, and the system of fixed size is solved. ``FOLDS`` sets of sums give out-of-fold
scores of all labelled rows; their histogram, of fixed size too, is calibrated by isotonic
regression. All labelled rows count; none are gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liveset.llm.common import Carried, Hasher, Words, flat, mixed, slices

FEATURES = 256
FOLDS = 4
RIDGE = 1e-3
BINS = 4096
#: Tasks that sum normal equations; each gives ``FOLDS * (FEATURES + 1)`` rows.
SUMMING_TASKS = 128
STATISTICS = (
    "log_bytes log_words log_lines word_length long_words upper digit mark odd_mark space other_bytes newline_share "
    "distinct_words distinct_pairs top_word distinct_lines word_entropy byte_entropy upper_words marked_words odd_ends "
    "stop_ends short_words line_words").split()


def _per_doc(doc: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(doc, values, n).astype(float)


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: number of different hashes, count of the commonest, entropy in bits."""
    if not len(doc):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    starts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
    size, of = np.diff(np.append(starts, len(d))), d[starts]
    top = np.zeros(n)
    np.maximum.at(top, of, size)
    total = _per_doc(doc, None, n)
    entropy = np.log2(np.maximum(total, 1)) - _per_doc(of, size * np.log2(size), n) / np.maximum(total, 1)
    return _per_doc(of, None, n), top, entropy


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """One row of ``STATISTICS`` per document of a slice; an empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    words = Words(data, offsets, hasher)
    count = np.diff(words.first).astype(float)
    doc_b = np.repeat(np.arange(n), np.diff(offsets))
    doc_w = np.repeat(np.arange(n), np.diff(words.first))
    kind = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 digit, 3 common mark, 4 odd mark, 5 space, 6 newline, 7 lower, 8 beyond ASCII
    kind[65:91], kind[48:58], kind[97:123], kind[128:] = 1, 2, 7, 8
    kind[33:48], kind[58:65], kind[91:97], kind[123:127] = 4, 4, 4, 4
    kind[[ord(c) for c in ".,;:'\"?-()"]], kind[[32, 9]], kind[10] = 3, 5, 6
    kinds = np.bincount(doc_b * 9 + kind[data], minlength=n * 9).reshape(n, 9)
    share = kinds / np.maximum(size, 1)[:, None]
    per_word = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    first, last = kind[data[words.start]], kind[data[words.end - 1]]
    n_distinct, top, entropy = _distinct(doc_w, words.hashes, n)
    at, pairs = words.windows(2)
    n_pairs, _, _ = _distinct(doc_w[at], pairs, n)
    # Lines: hash of the words between newlines.
    newline = np.cumsum(data == 10)
    line = newline[words.start] if len(words) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (doc_w[1:] != doc_w[:-1]))) if len(words) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(words))
    ups, downs = hasher.words.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words.hashes * ups[:-1], out=sums[1:])
    line_hash = mixed((sums[ends] - sums[starts]) * downs[starts])
    n_lines = _per_doc(doc_w[starts], None, n)
    lines, _, _ = _distinct(doc_w[starts], line_hash, n)
    bytes_of = np.bincount(doc_b * 256 + data, minlength=n * 256).reshape(n, 256)
    p = bytes_of / np.maximum(size, 1)[:, None]
    byte_entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    part = lambda x: _per_doc(doc_w, x.astype(float), n) / per_word
    upper_words = part((first == 1) & (last != 7))
    return np.stack([
        np.log1p(size), np.log1p(count), np.log1p(n_lines), part(length), part(length > 12), share[:, 1], share[:, 2], share[:, 3],
        share[:, 4], share[:, 5], share[:, 8], share[:, 6], n_distinct / per_word, n_pairs / per_word, top / per_word,
        lines / np.maximum(n_lines, 1), entropy, byte_entropy, upper_words, part(last == 3), part(last == 4),
        part((data[words.end - 1] == 46)) if len(words) else np.zeros(n), part(length < 4), count / np.maximum(n_lines, 1)], axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``stats``: an array of ``STATISTICS``."""
    carried = Carried(docs, ("doc_id",), ("text", "stats"))
    docs = docs.select(*carried.packed, F.col("text").alias("text"))
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        hasher = Hasher()
        for b in batches:
            data, offsets = flat(b.column("text"))
            parts = [statistics(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], hasher) for lo, hi in slices(offsets)]
            values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [lists], names=names + ["stats"])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select(*names, "text").mapInArrow(run, schema).select(*carried.columns(), "stats")


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """Scaling, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        d = len(mean)
        self.frequency = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.fold_weights = np.zeros((FOLDS, FEATURES + 1))
        self.edges, self.levels = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -5, 5)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ self.frequency + self.phase), np.ones((len(x), 1))])

    @staticmethod
    def fold(stats: np.ndarray) -> np.ndarray:
        """By the statistics themselves, so copies of a text share a fold."""
        mix = np.round(stats * 1e6).astype(np.int64).view(np.uint64)
        return (mixed(mix.sum(axis=1, dtype=np.uint64)) % np.uint64(FOLDS)).astype(np.int64)

    def solve(self, sums: np.ndarray) -> None:
        """``sums[f]``: products of features with each other and, last column, the labels."""
        def ridge(a):
            total = a[:, :-1]
            return np.linalg.solve(total + RIDGE * max(total[-1, -1], 1) * np.eye(len(total)), a[:, -1])

        whole = sums.sum(axis=0)
        self.weights = ridge(whole)
        self.fold_weights = np.stack([ridge(whole - sums[f]) for f in range(FOLDS)])

    def calibrate(self, score: np.ndarray, count: np.ndarray, positive: np.ndarray) -> None:
        """Isotonic regression of label on score by pooling neighbours that go down."""
        blocks: list[list[float]] = []
        for s, n, y in zip(score, count, positive):
            blocks.append([s * n, n, y])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.edges = np.array([b[0] / b[1] for b in blocks])
        self.levels = np.array([b[2] / b[1] for b in blocks])

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated score; a thousandth follows the raw score, so equal levels keep their order."""
        raw = self.features(stats) @ self.weights
        level = np.interp(raw, self.edges, self.levels)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fit(labelled: DataFrame) -> Model | None:
    """Model of rows with ``stats`` and ``label`` (0 or 1); ``None`` without rows."""
    d = len(STATISTICS)
    sums = labelled.agg(F.count(F.lit(1)).alias("n"), *[f(F.get("stats", k)).alias(f"{n}{k}") for k in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"]:
        return None
    model = Model(np.array([sums[f"m{k}"] for k in range(d)]), np.array([sums[f"s{k}"] for k in range(d)]))
    side = FEATURES + 1

    def normal(batches):
        total = np.zeros((FOLDS, side, side + 1))
        for b in batches:
            stats, y = _rows(b.column("stats")), b.column("label").to_numpy(zero_copy_only=False).astype(float)
            x, fold = model.features(stats), model.fold(stats)
            for f in range(FOLDS):
                mine = x[fold == f]
                total[f] += mine.T @ np.hstack([mine, y[fold == f][:, None]])
        n = FOLDS * side
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n, dtype=np.int32)),
             pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (side + 1)), pa.array(total.ravel()))], names=["row", "sums"])

    def add(table: pa.Table) -> pa.Table:
        sums_ = _rows(table.column("sums").combine_chunks()).sum(axis=0)
        return pa.table({"row": table.column("row").slice(0, 1), "sums": pa.array([sums_.tolist()])})

    parts = labelled.coalesce(SUMMING_TASKS).mapInArrow(normal, "row int, sums array<double>")
    rows = parts.groupBy("row").applyInArrow(add, "row int, sums array<double>").collect()  # FOLDS * (FEATURES + 1) rows
    total = np.zeros((FOLDS * side, side + 1))
    for r in rows:
        total[r["row"]] = r["sums"]
    model.solve(total.reshape(FOLDS, side, side + 1))

    def out_of_fold(batches):
        for b in batches:
            stats = _rows(b.column("stats"))
            raw = (model.features(stats) * model.fold_weights[model.fold(stats)]).sum(axis=1)
            bin_ = np.clip(np.round((raw + 1) / 3 * BINS), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), b.column("label")], names=["bin", "label"])

    bins = labelled.mapInArrow(out_of_fold, "bin int, label int").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).orderBy("bin").collect()  # BINS + 1 rows at most
    model.calibrate(*(np.array(x, float) for x in zip(*[(r["bin"] / BINS * 3 - 1, r["n"], r["y"]) for r in bins])))
    return model


def scored(measures: DataFrame, model: Model | None) -> DataFrame:
    """``measures`` (with ``stats``) with ``quality_score``, from 0 to 1; 0.5 without a model.
    Null and empty texts have statistics of zero and are scored like others."""
    carried = Carried(measures, ("doc_id",), ("stats", "quality_score"))
    if model is None:
        return measures.select(*carried.packed).select(*carried.columns(), F.lit(0.5).alias("quality_score"))
    measures = measures.select(*carried.packed, F.col("stats").alias("stats"))
    names = [c for c in measures.columns if c != "stats"]

    def run(batches):
        for b in batches:
            score = model.score(_rows(b.column("stats"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(score)], names=names + ["quality_score"])

    schema = T.StructType([measures.schema[c] for c in names] + [T.StructField("quality_score", T.DoubleType())])
    return measures.select(*names, "stats").mapInArrow(run, schema).select(*carried.columns(), "quality_score")
