"""Removal of word runs that repeat elsewhere, found through difference-cover anchors.

A window of ``window`` words repeats when its word sequence also starts anywhere else. To
find such windows without hashing and comparing every one, short runs (anchors) are hashed
only where the word place modulo ``PERIOD`` lies in a difference cover. For any two places
some shift below the period puts both on the cover, so two equal windows always share an
anchor that is hashed in both: no repeat is missed. Windows around anchors that occur more
than once are then hashed whole, and those that occur more than once repeat.

Occurrences meet once, sorted by their hash, and a stream over them marks those that are
not alone; they are never paired or gathered. Each batch first settles what repeats within
itself: those occurrences are marked at once and stand for the others as a single row, so
a passage shared by a third of all documents sends a row a batch, not a row a document.
Equal texts repeat each other whole: only the first of them is searched, for the others' sake.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liveset.llm.common import Carried, Hasher, Words, as_long, flat, mixed, runs, slices

WINDOW = 35
#: A perfect difference set: every non-zero residue modulo 21 is one difference of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ADDED = ("kept_text", "n_words", "n_removed")


#: Rows in the shuffle, three numbers each: a hash; 32 more bits of it and the place; the
#: document and the kind of row (alone in its batch, known to repeat, standing for others).
MARKS = "k long, at long, doc long"
ALONE, KNOWN, STANDS = 0, 1, 2


def _places(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and word place in it of word indexes."""
    doc = np.searchsorted(words.first, at, "right") - 1
    return doc, at - words.first[doc]


def _combined(found: list[tuple]) -> pa.RecordBatch | None:
    """Occurrences ``(h, g, rid, place)`` of a batch as rows. One that is alone goes by its
    hash. Those of a value that repeats here are known to repeat: they go by their place,
    spread evenly, and one row that stands for them goes by the hash."""
    if not found:
        return None
    h, g, rid, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((g, h))
    h, rid, at = h[order], rid[order], (g.astype(np.int64) << 32 | place)[order]
    new = np.append(True, (h[1:] != h[:-1]) | (at[1:] >> 32 != at[:-1] >> 32)) if len(h) else np.zeros(0, bool)
    alone = new & np.append(new[1:], True)[:len(new)]
    again, first = ~alone, new & ~alone
    spread = mixed(rid[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at[again].astype(np.uint64))
    return pa.RecordBatch.from_arrays([
        as_long(np.concatenate([h[alone], spread, h[first]])), pa.array(np.concatenate([at[alone], at[again], at[first]])),
        pa.array(np.concatenate([rid[alone] * 4 + ALONE, rid[again] * 4 + KNOWN, np.full(first.sum(), STANDS, np.int64)]))],
        names=["k", "at", "doc"])


def _repeating(batches):
    """Places of sorted rows that repeat: known ones, and those not alone with their value."""
    for table, _ in runs(batches, ["k"]):
        k, at, doc = (table.column(c).to_numpy() for c in ("k", "at", "doc"))
        kind, g = doc & 3, at >> 32
        counts = kind != KNOWN  # a known row has a hash of its own
        new = np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1]) | ~counts[1:] | ~counts[:-1])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(k)))
        take = ((np.repeat(size, size) > 1) & (kind == ALONE)) | (kind == KNOWN)
        if take.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[take] >> 2), pa.array((at[take] & 0xFFFFFFFF).astype(np.int32))], names=["_rid", "place"])


def _marked(occurrences: DataFrame) -> DataFrame:
    """``_rid`` and the places in it that repeat; a list is no longer than its document."""
    ordered = occurrences.repartition("k").sortWithinPartitions("k", "at")
    return ordered.mapInArrow(_repeating, "_rid long, place int").groupBy("_rid").agg(F.collect_list("place").alias("places"))


def _anchors(window: int):
    size = window - PERIOD + 1

    def run(batches):
        hasher, on_cover = Hasher(), np.isin(np.arange(PERIOD), COVER)
        for b in batches:
            data, offsets = flat(b.column("text"))
            rid, found = b.column("_rid").to_numpy(), []
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], hasher)
                at, hashes = words.windows(size)
                doc, place = _places(words, at)
                # Only documents that hold a whole window can repeat one.
                take = on_cover[place % PERIOD] & (np.diff(words.first)[doc] >= window)
                found.append((hashes[take], np.zeros(take.sum(), np.int32), rid[lo + doc[take]], place[take].astype(np.int32)))
            rows = _combined(found)
            if rows is not None:
                yield rows

    return run


def _candidates(window: int):
    size = window - PERIOD + 1

    def run(batches):
        first, second = Hasher(), Hasher(1)
        for b in batches:
            data, offsets = flat(b.column("text"))
            rid, lists = b.column("_rid").to_numpy(), b.column("places")
            cuts, values, found = lists.offsets.to_numpy(), lists.values.to_numpy(), []
            for lo, hi in slices(offsets):
                part, offs = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                words = Words(part, offs, first)
                at, hashes = words.windows(window)
                # Windows that hold a marked anchor: their start is at most window - size before it.
                near = np.zeros(len(words) + 1, np.int64)
                floor = np.repeat(words.first[:-1], np.diff(cuts[lo:hi + 1]))
                marked = values[cuts[lo]:cuts[hi]] + floor
                np.add.at(near, np.maximum(marked - (window - size), floor), 1)
                np.add.at(near, marked + 1, -1)
                take = np.cumsum(near)[at] > 0
                at = at[take]
                # 96 bits tell windows apart, however many there are.
                other = second.of_windows(second.of_words(part, words.start, words.end), at, window)
                doc, place = _places(words, at)
                found.append((hashes[take], (other >> np.uint64(32)).astype(np.uint32).view(np.int32), rid[lo + doc], place.astype(np.int32)))
            rows = _combined(found)
            if rows is not None:
                yield rows

    return run


def _strip(window: int, names: list[str]):
    def run(batches):
        hasher = Hasher()
        for b in batches:
            data, offsets = flat(b.column("text"))
            lists, copied = b.column("places"), b.column("_copied").to_numpy(zero_copy_only=False)
            cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo, hi in slices(offsets):
                part, offs = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                words = Words(part, offs, hasher)
                edge = np.zeros(len(words) + 1, np.int64)
                at = values[cuts[lo]:cuts[hi]] + np.repeat(words.first[:-1], np.diff(cuts[lo:hi + 1]))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                doc, _ = _places(words, np.arange(len(words)))
                whole = copied[lo:hi] & (np.diff(words.first) >= window)
                gone = (np.cumsum(edge)[:-1] > 0) | whole[doc]
                # A removed word goes with the gap after it; a document's layout stays otherwise.
                until = np.append(words.start[1:], len(part))
                until = np.minimum(until, offs[doc + 1])
                turn = np.zeros(len(part) + 1, np.int32)
                np.add.at(turn, words.start[gone], 1)
                np.add.at(turn, until[gone], -1)
                keep = np.cumsum(turn)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[offs].astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(kept), pa.py_buffer(part[keep].tobytes())])
                counts = np.diff(words.first)
                removed = np.bincount(doc[gone], minlength=hi - lo)
                here = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [here.column(c) for c in names] + [text, pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64))],
                    names=names + list(ADDED))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept_text`` (the text without the words of repeating windows, gaps
    otherwise as they were), ``n_words`` and ``n_removed``; columns of ``docs`` with these
    names are replaced, all others pass through.

    Words are runs of characters other than ASCII white space, unchanged. A window repeats
    when it also starts at another place, in the same document or another; all windows are
    judged on the input. Repeated rows repeat each other. Null and empty texts, and texts
    below ``window`` words, lose nothing (null: no words, an empty text). ``docs`` is read
    several times and must give the same rows in the same partitions each time, as files do.
    """
    if window < PERIOD:
        raise ValueError(f"windows must have at least {PERIOD} words")
    carried = Carried(docs, ("text",), ADDED)
    docs = carried.df
    names = docs.columns
    rows = docs.select(*names).withColumn("_rid", F.monotonically_increasing_id())
    keys = rows.filter("text is not null").select("_rid", F.unhex(F.md5("text")).alias("_key"))
    groups = keys.groupBy("_key").agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copied = keys.join(groups, "_key").select("_rid", (F.col("_rid") != F.col("_first")).alias("_later"))
    # All joins take the same columns, so that the texts are exchanged once.
    searched = rows.join(copied.filter("_later").select("_rid"), "_rid", "left_anti").select("_rid", *names)
    marked = _marked(searched.mapInArrow(_anchors(window), MARKS))
    windows = rows.join(marked, "_rid").select("_rid", *names, "places").mapInArrow(_candidates(window), MARKS)
    found = _marked(windows)
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    joined = rows.join(found, "_rid", "left").join(copied, "_rid", "left").select(
        "_rid", *names, F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.col("_later").isNotNull().alias("_copied"))
    return joined.mapInArrow(_strip(window, names), schema).select(*carried.columns(), *ADDED)


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same by definition, for tests: words, removed words, digest of the kept ones."""
    import re

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen: dict[tuple, int] = {}
    for w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
