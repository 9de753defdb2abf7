"""Benchmark items inside documents: size-partitioned MinHash containment search, native.

Similarity of a short item and a long document says little, so documents are partitioned by
size and every partition compares sketches of its own resolution. A sketch holds, for each
of ``2**bits`` bins of the hash space, the minimum of the shingle hashes in it
(one-permutation MinHash). ``bits`` is the partition's size class plus ``extra`` bits; a
shingle of the document is its bin's minimum but for a chance below load/2, at any document
length. ``extra`` follows from the smallest item: with at least m shingles of an item in a
document, the chance that none is a minimum in both is below ``(load / 2)**m``, held
under ``MISS``. Each item is sketched once per resolution that occurs.

A document that shares a bin minimum with an item is verified on the shingles' words
themselves: how many of the item's distinct shingles it contains. Everything is DataFrame
functions. Sketches are made within the row (a sorted array; each bin's first value), so
documents reach the shuffle only as matches: the texts to verify are filtered in the scan by
the ids that matched, as long as these are few enough to be sent.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset.functions.text import let
from liveset.llm.common import Carried
from liveset.scale import checkpoint

SHINGLE, THRESHOLD = 5, 0.8
MISS = 1e-9
#: Item sketches up to this many rows (24 bytes each) are sent to every executor.
BROADCAST_ROWS = 1_000_000
#: The same for ids of documents that match (8 bytes each).
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def _grams(w: Column, n: int, hashed: bool) -> Column:
    """Every run of ``n`` words: its hash, or the words themselves."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    if hashed:
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, n), " "))


def hashes(w: Column, sizes: list[int]) -> Column:
    return F.concat(*[_grams(w, n, True) for n in sizes])


def exact(w: Column, sizes: list[int]) -> Column:
    return F.array_distinct(F.concat(*[_grams(w, n, False) for n in sizes]))


def minima(ordered: Column, bits: Column) -> Column:
    """The first of an ordered array's values in each of ``2**bits`` bins (upper bits)."""
    bin_of = lambda x: F.call_function("shiftright", x, (F.lit(64) - bits).cast("int"))
    return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))


def extra_bits(least_shingles: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Bits beyond a document's size class at which a contained item is missed with a chance
    of at most ``miss``; every one of the needed shingles must fail to be a minimum."""
    needed = max(1, ceil(threshold * least_shingles - 1e-9))
    bits = 0
    while (2.0 ** -bits / 2) ** needed > miss:
        bits += 1
    return bits


def _sent(ids: DataFrame) -> DataFrame:
    """Ids for a join, sent to every executor where they are proven few, so that the other side
    stays where it is."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return F.broadcast(ids) if few else ids


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``_rid``, ``_item`` (MD5 of the item's text), ``n_shared``, ``n_item``: pairs in which a
    document (``_rid``, ``text``) has at least ``threshold`` of an item's distinct shingles.

    Shingles are five words; words are runs of characters other than ASCII white space,
    unchanged. An item below five words is one shingle of its own length. Items and texts
    that are null, or have no word, match nothing.
    """
    text = items.filter("text is not null").select("text").distinct()
    split_items = text.select(F.md5("text").alias("_item"), words(F.col("text")).alias("w"))
    item_sets = checkpoint(split_items.select("_item", let(F.col("w"), lambda w: F.struct(
        F.least(F.size(w), F.lit(SHINGLE)).alias("n"), w.alias("w"),
        F.when(F.size(w) >= SHINGLE, exact(w, [SHINGLE])).otherwise(F.array(F.array_join(w, " "))).alias("shingles"))).alias("i"),
    ).select("_item", "i.*").filter("n > 0"))
    kinds = item_sets.groupBy("n").agg(F.min(F.size("shingles")).alias("least")).collect()  # at most five rows
    sizes = sorted({SHINGLE, *(r["n"] for r in kinds)}, reverse=True)
    extra = extra_bits(min([r["least"] for r in kinds], default=1), threshold)

    # One nested expression, every part of it computed once a row. Size class c holds
    # documents of up to 2**c shingles.
    def sketch(ordered: Column) -> Column:
        bits = F.ceil(F.log2(F.greatest(F.size(ordered), F.lit(1)).cast("double"))) + extra
        return let(F.least(bits, F.lit(63)).cast("int"), lambda b: F.struct(b.alias("bits"), minima(ordered, b).alias("x")))

    of_words = lambda w: let(F.sort_array(F.array_distinct(hashes(w, sizes))), sketch)
    sketches = docs.select("_rid", let(words(F.col("text")), of_words).alias("k")).select(
        "_rid", F.coalesce("k.bits", F.lit(0)).alias("bits"), F.explode_outer("k.x").alias("x"))

    own = F.when(F.col("n") >= SHINGLE, hashes(F.col("w"), [SHINGLE]))
    for n in sizes[1:]:
        own = own.when(F.col("n") == n, hashes(F.col("w"), [n]))
    # A value is its bin's minimum at every resolution that parts it from the value before:
    # one row says so for all partitions.
    probes = item_sets.select("_item", F.sort_array(F.array_distinct(own)).alias("s")).select(
        "_item", "s", F.posexplode_outer("s").alias("i", "x")).withColumn(
        "from_bits", F.when(F.col("i") == 0, 0).otherwise(65 - F.length(F.bin(F.col("x").bitwiseXOR(F.get("s", F.col("i") - 1))))))
    probes = probes.select("_item", "x", "from_bits")
    if probes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        probes = F.broadcast(probes)
    found = checkpoint(sketches.join(probes, "x").filter("bits >= from_bits").select("_rid", "_item").distinct())

    met = docs.select("_rid", "text").join(_sent(found.select("_rid").distinct()), "_rid", "left_semi")
    texts = found.join(met, "_rid").join(item_sets.select("_item", "shingles"), "_item")
    have = let(words(F.col("text")), lambda w: exact(w, sizes))
    shared = texts.select("_rid", "_item", F.size(F.array_intersect(have, F.col("shingles"))).alias("n_shared"),
                          F.size("shingles").alias("n_item"))
    return shared.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item`` of every document that contains an item. Ids may
    be null. A repeated document row gives its pairs again; a repeated item row does not,
    unless its ``item_id`` differs. Other columns are ignored. ``docs`` is read twice and
    must give the same rows in the same partitions each time, as files do."""
    rows = docs.select("doc_id", "text").withColumn("_rid", F.monotonically_increasing_id())
    found = checkpoint(contained(rows, items, threshold))
    names = items.select("item_id", F.md5("text").alias("_item")).distinct()
    ids = rows.select("_rid", "doc_id").join(_sent(found.select("_rid").distinct()), "_rid", "left_semi")
    return found.join(ids, "_rid").join(names, "_item").select("doc_id", "item_id", "n_shared", "n_item")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that contain no item; all columns pass through."""
    carried = Carried(docs, ("text",))
    rows = carried.df.withColumn("_rid", F.monotonically_increasing_id())
    found = checkpoint(contained(rows.select("_rid", "text"), items, threshold).select("_rid").distinct())
    return rows.join(_sent(found), "_rid", "left_anti").select(*carried.columns())
