"""Language identification with a byte convolutional network, trained here in numpy.

The network reads fixed windows of ``WINDOW`` bytes: filters of several widths over one-hot
bytes, the maximum of each filter over the window, and a softmax over the languages. It is
trained on a bounded sample (``SAMPLE_ROWS`` labelled texts, evenly over the languages, and
``CUTS`` runs of ``WINDOW`` characters of each, at places a hash chooses) and applied to every window of every whole text; a text's probabilities are the mean over its
windows, weighted by their bytes.

Filters over one-hot bytes are table look-ups. For application the tables of neighbouring
bytes are summed beforehand, so a filter costs one or two look-ups a place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liveset.llm.common import Carried, flat, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_ROWS = 4_000
CUTS = 2  # runs of WINDOW characters taken from a sampled text, with all their bytes
UNKNOWN = "und"
ADDED = ("lang_pred", "lang_score")


def cut(text: bytes) -> np.ndarray:
    """Windows of a text: end to end, the last one moved back to end with the text; a
    shorter text is filled up with zeros."""
    starts, _ = window_starts(np.array([0, len(text)]))
    data = np.frombuffer(text + bytes(WINDOW), np.uint8)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < len(text), data[at], 0).astype(np.uint8)


def window_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of documents end to end, and its document."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[doc] + np.minimum(k * WINDOW, np.maximum(size[doc] - WINDOW, 0)), doc


class Network:
    """``tables[w][j]``: response of each filter of width ``w`` to a byte at its place ``j``."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 2):
        """Adam on the cross entropy. Gradients reach a filter only at the place of its maximum."""
        rng = np.random.default_rng(seed)
        parts = [*(self.tables[w] for w in WIDTHS), self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), batch):
                x, y = windows[order[k:k + batch]], target[order[k:k + batch]]
                n, grads, best = len(x), [], []
                for w in WIDTHS:
                    span = WINDOW - w + 1
                    r = self.tables[w][0][x[:, :span]]
                    for j in range(1, w):
                        r += self.tables[w][j][x[:, j:j + span]]
                    best.append(r.argmax(axis=1))
                    grads.append(np.take_along_axis(r, best[-1][:, None, :], 1)[:, 0])
                hidden = np.concatenate(grads, axis=1) + self.bias
                active = np.maximum(hidden, 0)
                logits = active @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), y] -= 1
                p /= n
                back = (p @ self.out.T) * (hidden > 0)
                steps = []
                for i, w in enumerate(WIDTHS):
                    g, mine = np.zeros_like(self.tables[w]), back[:, i * FILTERS:(i + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (x[np.arange(n)[:, None], best[i] + j], np.arange(FILTERS)[None, :]), mine)
                    steps.append(g)
                steps += [back.sum(axis=0), active.T @ p, p.sum(axis=0)]
                t += 1
                for part, g, a, b in zip(parts, steps, m, v):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    part -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def look_ups(self) -> None:
        """Tables of byte pairs: one look-up for two places of a filter."""
        pair = lambda t, j: (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)
        self.pairs = {w: [pair(self.tables[w], j) for j in range(0, w - 1, 2)] for w in WIDTHS}

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of each window (rows of ``WINDOW`` bytes)."""
        if not hasattr(self, "pairs"):
            self.look_ups()
        two = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        pooled = []
        for w in WIDTHS:
            span = WINDOW - w + 1
            r = np.take(self.pairs[w][0], two[:, :span], axis=0)
            for j in range(2, w - 1, 2):
                r += np.take(self.pairs[w][j // 2], two[:, j:j + span], axis=0)
            if w % 2:
                r += np.take(self.tables[w][w - 1], x[:, w - 1:], axis=0)
            while span > 1:  # the maximum, by halves
                half = (span + 1) // 2
                r = np.maximum(r[:, :half], r[:, span - half:span])
                span = half
            pooled.append(r[:, 0])
        logits = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """About ``rows`` different labelled texts, as ``(lang, cuts)``: of each language its even
    share, or all it has, and one at least. Which ones depends on a hash of the text alone."""
    # By different texts, as copies are one text of the sample; one row a language.
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    if not counts:
        return []
    share = max(1, -(-rows // len(counts)))
    # Somewhat more than the share is drawn, so that chance leaves no language short of it.
    keep = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.2 * share + 50) / max(n, 1)))])
    h = F.xxhash64("text")
    chosen = labelled.withColumn("h", h).filter((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < F.element_at(keep, F.col("lang")))
    size = F.greatest(F.length("text") - WINDOW, F.lit(0))
    cuts = F.array(*[F.substring("text", (F.pmod(F.shiftright("h", 5 + 9 * k), size + 1) + 1).cast("int"), F.lit(WINDOW)) for k in range(CUTS)])
    # Copies share their hash, so they fall together before anything is counted or brought to the driver.
    texts = chosen.groupBy("lang", "h").agg(F.any_value(cuts).alias("cuts"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    rows_ = sorted(texts.withColumn("_n", first).filter(F.col("_n") <= share).collect(), key=lambda r: (r["h"], r["lang"]))
    return [(r["lang"], r["cuts"]) for r in rows_]


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """Network for rows of ``lang`` and ``text``; null languages and texts without a letter
    are left out. ``None`` where nothing is left."""
    got = sample(labelled.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select("lang", "text"), rows)
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    # Every window of a cut, so that scripts of several bytes a letter count with all of theirs.
    pairs = [(window, languages.index(lang)) for lang, cuts in got for c in cuts if c for window in cut(c.encode())]
    if not pairs:
        return None
    windows, target = np.stack([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    network = Network(languages).fit(windows, target)
    network.look_ups()
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (mean probability of that language);
    same-named columns are replaced. Null texts and texts without a letter are ``und`` with
    score 0, as is every text without a network. Only the text is looked at."""
    carried = Carried(docs, ("text",), ADDED)
    docs = carried.df
    names = docs.columns
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if network is None:
        return docs.select(*carried.columns(), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"))

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column("text"))
            has = b.column("_letter").to_numpy(zero_copy_only=False)
            pred, score = np.full(len(has), UNKNOWN, object), np.zeros(len(has))
            for lo, hi in slices(offsets):
                part = np.append(data[offsets[lo]:offsets[hi]], np.zeros(WINDOW, np.uint8))
                offs = offsets[lo:hi + 1] - offsets[lo]
                starts, doc = window_starts(offs)
                take = has[lo + doc]
                starts, doc = starts[take], doc[take]
                if not len(starts):
                    continue
                size = np.diff(offs)[doc]
                p = np.empty((len(starts), len(network.languages)))
                for k in range(0, len(starts), 128):
                    x = part[starts[k:k + 128, None] + np.arange(WINDOW)]
                    short = size[k:k + 128] < WINDOW
                    if short.any():
                        x[short] = np.where(np.arange(WINDOW) < size[k:k + 128][short][:, None], x[short], 0)
                    p[k:k + 128] = network.probabilities(x)
                weight = np.minimum(size, WINDOW).astype(float)
                total = np.stack([np.bincount(doc, p[:, c] * weight, hi - lo) for c in range(p.shape[1])], axis=1)
                mean = total / np.maximum(np.bincount(doc, weight, hi - lo), 1e-9)[:, None]
                best = mean.argmax(axis=1)
                here = np.flatnonzero(has[lo:hi] & (np.diff(offs) > 0))
                pred[lo + here] = np.array(network.languages, object)[best[here]]
                score[lo + here] = np.clip(mean[here, best[here]], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(score)], names=names + list(ADDED))

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.select(*names, letter.alias("_letter")).mapInArrow(run, schema).select(*carried.columns(), *ADDED)
