"""Helpers shared by the training-data operators.

Texts reach Python as Arrow string columns, whose bytes are read in place: words are
found and hashed with numpy over the flat bytes of many documents at once, never one
Python object per word. Every function here works on a bounded slice of a batch.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liveset.scale import checkpoint, shared_folder

SLICE_BYTES = 1 << 20
_M = (1 << 64) - 1


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: no lineage, read again from any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(name: str, modulus: int) -> Column:
    """crc32 of an id's text, modulo: which rows are held out. A null id counts as 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % modulus, F.lit(0))


class Carried:
    """A frame with the columns that an operator works on, under their own names, and all others
    as one. No name of theirs, in any case, can then meet a name that the operator uses itself.
    Columns named like ``added`` ones are left out: the operator's own take their place."""

    def __init__(self, docs: DataFrame, needed: tuple[str, ...], added: tuple[str, ...] = ()):
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        replaced = {a.lower() for a in added}
        self.kept = [c for c in docs.columns if c.lower() not in replaced]
        self.own = {c: n for c in self.kept for n in needed if c.lower() == n.lower()}
        others = [c for c in self.kept if c not in self.own]
        #: What to select of the given frame.
        self.packed = [quoted(c).alias(n) for c, n in self.own.items()]
        if others:
            self.packed.append(F.struct(*[quoted(c).alias(c) for c in others]).alias("_others"))
        self.df = docs.select(*self.packed)

    def columns(self) -> list[Column]:
        """The columns as they were given, of a frame that has those of ``df``."""
        return [(F.col(self.own[c]) if c in self.own else F.col("_others").getField(c)).alias(c) for c in self.kept]


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space, as an array."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)


# --- flat bytes ---------------------------------------------------------------------------

def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null(b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of documents of about ``most`` bytes; a longer document stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _rise(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = self._rise(self.base, size), self._rise(self.inverse, size)
        return self.up[:n], self.down[:n]


class Words:
    """Words of a slice of documents.

    ``start`` and ``end`` are byte places, ``first`` the index of each document's first
    word (one more entry than documents), ``hashes`` a 64-bit hash per word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher):
        gap = np.ones(len(data) + 1, bool)
        gap[:-1] = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = ~gap
        starts[1:] &= gap[:-1] | edge[1:]
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] = ~gap[:-1] & (gap[1:] | edge[1:])
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = hasher.of_words(data, self.start, self.end)
        self._hasher = hasher

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of ``size`` words of one document."""
        n = len(self)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        counts = np.diff(self.first)
        inside = np.arange(n) + size <= np.repeat(self.first[1:], counts)
        at = np.flatnonzero(inside)
        return at, self._hasher.of_windows(self.hashes, at, size)


class Hasher:
    """Prefix-sum hashes: a run's hash is a difference of two sums, moved to a common place."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(20_240_101 + seed)
        self.letters = rng.integers(0, 1 << 64, 256, np.uint64)
        odd = lambda: int(rng.integers(0, 1 << 64, dtype=np.uint64)) | 1
        self.bytes, self.words = Powers(odd()), Powers(odd())

    def of_words(self, data, start, end) -> np.ndarray:
        up, down = self.bytes.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * up[:-1], out=sums[1:])
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def of_windows(self, hashes, at, size: int) -> np.ndarray:
        up, down = self.words.upto(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        return mixed((sums[at + size] - sums[at]) * down[at] + np.uint64(size))


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document. A document of fewer than ``size``
    words has its whole word sequence as one shingle; one without words has none."""
    at, hashes = words.windows(size)
    doc_of = np.searchsorted(words.first, at, "right") - 1
    cuts = np.searchsorted(doc_of, np.arange(len(words.first)))
    out = []
    for d in range(len(words.first) - 1):
        here = hashes[cuts[d]:cuts[d + 1]]
        n = words.first[d + 1] - words.first[d]
        if 0 < n < size:
            here = words._hasher.of_windows(words.hashes, words.first[d:d + 1], int(n))
        out.append(np.unique(here))
    return out


def as_long(hashes: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))


# --- runs of equal group columns ------------------------------------------------------------

def runs(batches, group: list[str]):
    """Sorted batches cut so that every run of equal ``group`` values is in one table.
    Yields the table and the runs' starts (one more than runs)."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        n = table.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for c in group:
            column = table.column(c).combine_chunks()
            if pa.types.is_integer(column.type):
                v = column.to_numpy(zero_copy_only=False)
            else:
                data, offsets = flat(column)  # keys of one length
                v = data.reshape(n, -1)
            new[1:] |= (v[1:] != v[:-1]).reshape(n - 1, -1).any(axis=1)
        starts = np.flatnonzero(new)
        rest = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


# --- connected components -----------------------------------------------------------------

def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``root`` (smallest node it is linked to, directly or not) of every node of
    ``edges``, by alternating large and small stars until nothing changes.

    Each round is two shuffles of the edges and keeps no more of them than there were;
    a node's partners meet as a combined minimum, never as a list. Rounds grow with the
    logarithm of the longest chain. Every round is written to the shared folder.
    """
    edges = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct()
    edges = checkpoint(edges)
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = big.filter("u <> v").distinct()
        floor = small.groupBy("u").agg(F.min("v").alias("m"))
        linked = small.join(floor, "u")
        edges = checkpoint(
            linked.select(F.col("u"), F.col("m").alias("v"))
            .union(linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
