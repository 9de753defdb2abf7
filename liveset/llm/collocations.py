"""Phrases whose words occur together, from weighted acyclic automata of n-gram counts.

1. Every task splits texts into pieces and words, counts words, and adds word and word-pair
   hashes to counters that stop at ``least``. Summed, they tell for certain which words and
   pairs are too rare to be part of a phrase.
2. Every shard of a task sorts its n-grams (the run of at most ``longest`` words that starts at
   a word and ends before anything too rare) and builds a count transducer from them, which is
   written. The count of a phrase is that of the n-grams it begins.
3. The n-gram space is cut into ranges of about equal size. Each transducer is cut there, and a
   task unites the parts of its ranges and sums weights. Only paths at the edge of a range go on
   to be summed with those of its neighbours; of the others, the frequent ones remain.
4. Candidates are dealt over groups. Each group asks once for every part that its cuts need; the
   parts' counts become a transducer, with which the cuts are composed.

Counts are exact: rare n-grams are left out only where a sum of counters proves them rare.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liveset.llm.automata import Tree, compose, dictionary, union
from liveset.llm.common import Hasher, flat, mixed, partitions, slices, written

LEAST, LONGEST, FIRST = 100, 5, 2000
NO_LANG = "und"
SHARD_BYTES = 8 << 20
#: Counters of words and pairs, and how many of them a row carries.
COUNTERS, CELLS = 1 << 24, 1 << 16
#: N-grams of a range that the driver sees to place the cuts.
SEEN_A_RANGE = 20
#: Arcs that a task collects before it unites them.
ARCS = 1 << 22
#: Candidates of a group that is scored at a time.
GROUP = 50_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_PAIR = np.uint64(0xD6E8FEB86659FD93)


# --- words -----------------------------------------------------------------------------------
class Shard:
    """Words of some documents. ``label`` is a word's place among ``words``, the distinct words
    and languages in ascending order; ``lang`` and ``piece`` are those of its document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        data = _LOWER[data]
        ends, gap = _PIECE_END[data], _BLANK[data]
        letter = np.zeros(len(data) + 2, bool)
        letter[1:-1] = ~(ends | gap)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(letter[1:] & (~letter[:-1] | edge))
        stop = np.flatnonzero(letter[:-1] & (~letter[1:] | edge))
        kept = data[letter[1:-1]]
        places = np.append(0, np.cumsum(stop - start)).astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(kept.tobytes())])
        self.words, place = dictionary(pa.concat_arrays([texts, langs.cast(pa.large_binary())]))
        self.label, of_doc = place[:len(start)], place[len(start):]
        doc = np.searchsorted(offsets, start, "right") - 1
        self.lang = of_doc[doc]
        breaks = np.flatnonzero(ends)
        self.piece = doc + np.searchsorted(breaks, start)  # grows at every break and document
        raw, cuts = flat(self.words)
        self._hash = Hasher().of_words(raw, cuts[:-1], cuts[1:])

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Counter of every word, and of the pair it makes with the next one (-1: no pair)."""
        word = mixed(self._hash[self.label] * _PAIR + self._hash[self.lang])
        pair = np.full(len(word), -1, np.int64)
        if len(word) > 1:
            both = mixed(word[:-1] * _PAIR + word[1:] + np.uint64(1))
            pair[:-1] = np.where(self.piece[1:] == self.piece[:-1], (both % np.uint64(COUNTERS)).astype(np.int64), -1)
        return (word % np.uint64(COUNTERS)).astype(np.int64), pair

    def grams(self, frequent: np.ndarray, longest: int) -> Tree:
        """Transducer of the n-grams that begin at each word, cut before what is too rare."""
        word, pair = self.cells()
        begins = np.flatnonzero(_bits(frequent, word))
        goes_on = (pair >= 0) & _bits(frequent, np.maximum(pair, 0))
        bits = max(1, int(len(self.words) + 1).bit_length())
        columns, alive = [self.lang[begins], self.label[begins]], np.ones(len(begins), bool)
        for k in range(1, longest):
            alive = alive & goes_on[np.minimum(begins + k - 1, len(word) - 1)]
            columns.append(np.where(alive, self.label[np.minimum(begins + k, len(word) - 1)], -1))
        # Columns side by side in as few sort keys as hold them.
        keys, room = [np.zeros(len(begins), np.uint64)], 64
        for c in columns:
            if room < bits:
                keys.append(np.zeros(len(begins), np.uint64))
                room = 64
            keys[-1] = keys[-1] << np.uint64(bits) | (c + 1).astype(np.uint64)
            room -= bits
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        at = np.flatnonzero(new)
        rows = np.stack([c[order[at]] for c in columns], axis=1) if len(at) else np.zeros((0, longest + 1), np.int64)
        whole = Tree(self.words, [])
        return whole.part(rows, np.diff(np.append(at, len(order))))


def _bits(packed: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about ``SHARD_BYTES``, cut between documents, a longer document between
    pieces."""
    for lo, hi in slices(offsets, SHARD_BYTES):
        start, stop = int(offsets[lo]), int(offsets[hi])
        while stop - start > 2 * SHARD_BYTES:
            ends = np.flatnonzero(_PIECE_END[data[start + SHARD_BYTES:stop]])
            if not len(ends):
                break
            cut = start + SHARD_BYTES + int(ends[0]) + 1
            yield start, cut, lo, hi
            start = cut
        yield start, stop, lo, hi


def _shards(batches):
    for b in batches:
        data, offsets = flat(b.column("text"))
        langs = b.column("lang")
        for start, stop, lo, hi in _blocks(data, offsets):
            if stop > start:
                cuts = np.clip(offsets[lo:hi + 1], start, stop) - start
                yield Shard(data[start:stop], cuts, langs.slice(lo, hi - lo))


# --- 1: what is too rare -----------------------------------------------------------------------
SKETCH = "part int, lang string, n long, cells binary"


def _sketch(least: int):
    def run(batches):
        cells, total = np.zeros(COUNTERS, np.uint8), {}
        for shard in _shards(batches):
            word, pair = shard.cells()
            found, counts = np.unique(np.concatenate([word, pair[pair >= 0]]), return_counts=True)
            cells[found] = np.minimum(cells[found] + counts, least)
            langs, n = np.unique(shard.lang, return_counts=True)
            for lang, some in zip(shard.words.take(pa.array(langs)).to_pylist(), n.tolist()):
                total[lang] = total.get(lang, 0) + some
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(total), pa.int32()), pa.array(list(total), pa.binary()).cast(pa.string()),
                pa.array(list(total.values()), pa.int64()), pa.nulls(len(total), pa.binary())], names=["part", "lang", "n", "cells"])
            for i, part in enumerate(cells.reshape(-1, CELLS)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()),
                        pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "lang", "n", "cells"])

    return run


def _summed(least: int):
    def run(batches):
        sums: dict[int, np.ndarray] = {}  # COUNTERS / CELLS entries at most
        for b in batches:
            for i, raw in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                more = np.frombuffer(zlib.decompress(raw), np.uint8)
                sums[i] = np.minimum(sums[i].astype(np.uint16) + more, least).astype(np.uint8) if i in sums else more
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(sums), pa.int32()), pa.array([np.packbits(s >= least).tobytes() for s in sums.values()], pa.binary())],
                names=["part", "bits"])

    return run


# --- 2: transducers of shards --------------------------------------------------------------------
def _transducers(frequent: np.ndarray, longest: int):
    def run(batches):
        for shard in _shards(batches):
            tree = shard.grams(frequent, longest)
            rows = tree.rows()[0]
            if len(rows):
                raw, size = tree.pack()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(rows)], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], names=["grams", "size", "raw"])

    return run


def _seen(step: int):
    """Every ``step``-th n-gram of a transducer, from a place that its content chooses."""
    def run(batches):
        for b in batches:
            for size, raw in zip(b.column("size").to_pylist(), b.column("raw").to_pylist()):
                tree = Tree.unpack(raw, size)
                rows = tree.rows()[0][zlib.crc32(raw) % step::step]
                words = tree.words.to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([[words[i] for i in r if i >= 0] for r in rows.tolist()], pa.list_(pa.binary()))], names=["gram"])

    return run


def _cut(cuts: list[list[bytes]]):
    """Transducers cut at the borders, one row a range that they have n-grams in."""
    def run(batches):
        depth = None
        for b in batches:
            for size, raw in zip(b.column("size").to_pylist(), b.column("raw").to_pylist()):
                tree = Tree.unpack(raw, size)
                rows, counts = tree.rows()
                depth = rows.shape[1]
                # Borders and n-grams in one order: both by places in one dictionary.
                flat_cuts = pa.array([w for c in cuts for w in c], pa.large_binary())
                words, place = dictionary(pa.concat_arrays([tree.words, flat_cuts]))
                mine, theirs = place[:len(tree.words)], place[len(tree.words):]
                borders, at = np.full((len(cuts), depth), -1, np.int64), 0
                for i, c in enumerate(cuts):
                    borders[i, :len(c)] = theirs[at:at + len(c)]
                    at += len(c)
                placed = np.where(rows >= 0, mine[np.maximum(rows, 0)], -1)
                both = np.concatenate([borders, placed])
                order = np.lexsort([np.arange(len(both)), *both.T[::-1]])  # equal ones: the border first
                range_of = np.cumsum(order < len(cuts))[order >= len(cuts)]
                edges = np.flatnonzero(np.append(True, range_of[1:] != range_of[:-1]))
                for lo, hi in zip(edges, np.append(edges[1:], len(range_of))):
                    part, plain = tree.part(rows[lo:hi], counts[lo:hi]).pack()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([range_of[lo]], pa.int64()), pa.array([plain], pa.int64()), pa.array([part], pa.binary())], names=["part", "size", "raw"])

    return run


# --- 3: union of a range ---------------------------------------------------------------------------
COUNTS = "lang string, phrase string, n_words int, f long"


def _joined(table: pa.Array, paths: np.ndarray) -> pa.Array:
    """Words of paths joined by a space."""
    return pc.binary_join_element_wise(*[table.take(pa.array(c)) for c in paths.T], b" ").cast(pa.string())


def _frequent(tree: Tree, least: int):
    words = tree.words.cast(pa.binary())
    for k in range(1, len(tree.layers)):
        label, weight, _ = tree.layers[k]
        take = weight >= least
        take[:1] = take[-1:] = True  # a path at the edge goes on in the neighbouring range
        arcs = np.flatnonzero(take)
        if len(arcs):
            paths = tree.paths(k, arcs)
            yield pa.RecordBatch.from_arrays([
                words.take(pa.array(paths[:, 0])).cast(pa.string()), _joined(words, paths[:, 1:]),
                pa.array(np.full(len(arcs), k, np.int32)), pa.array(weight[arcs])], names=["lang", "phrase", "n_words", "f"])


def _united(least: int):
    def run(batches):
        trees, held, arcs, room = [], None, 0, ARCS
        for b in batches:
            for part, size, raw in zip(*(b.column(c).to_pylist() for c in ("part", "size", "raw"))):
                if part != held and trees:
                    yield from _frequent(union(trees), least)
                    trees, arcs, room = [], 0, ARCS
                held = part
                trees.append(Tree.unpack(raw, size))
                arcs += sum(len(label) for label, _, _ in trees[-1].layers)
                if arcs > room and len(trees) > 1:
                    trees = [union(trees)]
                    arcs = sum(len(label) for label, _, _ in trees[0].layers)
                    room = max(ARCS, 2 * arcs)
        if trees:
            yield from _frequent(union(trees), least)

    return run


# --- 4: parts and scores -----------------------------------------------------------------------------
def _tree_of(langs: pa.Array, phrases: pa.Array, counts: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """Automaton of distinct phrases, and the sorted order they stand in."""
    lists = pc.split_pattern(phrases.cast(pa.large_binary()), b" ")
    sizes = pc.list_value_length(lists).to_numpy()
    words, place = dictionary(pa.concat_arrays([langs.cast(pa.large_binary()), lists.flatten().cast(pa.large_binary())]))
    rows = np.full((len(phrases), depth), -1, np.int64)
    rows[:, 0] = place[:len(phrases)]
    inside = np.arange(depth - 1) < sizes[:, None]
    rows[:, 1:][inside] = place[len(phrases):]
    order = np.lexsort(rows.T[::-1])
    return Tree.of_sorted(words, rows[order], counts[order]), order


def _ends(tree: Tree) -> np.ndarray:
    """Layer and arc at which each of the sorted rows of an automaton of distinct rows ends."""
    found = []
    for k, (label, weight, _) in enumerate(tree.layers):
        own = weight.copy()
        if k + 1 < len(tree.layers):
            np.subtract.at(own, tree.layers[k + 1][2], tree.layers[k + 1][1])
        arcs = np.flatnonzero(own > 0)
        paths = np.full((len(arcs), len(tree.layers)), -1, np.int64)
        paths[:, :k + 1] = tree.paths(k, arcs)
        found.append((paths, np.full(len(arcs), k), arcs))
    paths, layer, arc = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort(paths.T[::-1])
    return np.stack([layer[order], arc[order]], axis=1)


def _weights_of(langs: list, parts: list, counts: Tree, depth: int) -> dict[tuple[str, str], int]:
    """Weight of each part: the parts as an automaton, composed with the counts."""
    asked, order = _tree_of(pa.array(langs, pa.string()), pa.array(parts, pa.string()), np.ones(len(parts), np.int64), depth)
    weights, ends = compose(asked, counts), _ends(asked)
    return {(langs[i], parts[i]): int(weights[k][a]) for i, (k, a) in zip(order.tolist(), ends.tolist())}


SCORED = "lang string, phrase string, a long, l long, r long, n long, score long, whole_of array<string>"


def _scored(longest: int):
    def run(candidates: pa.Table, looked_up: pa.Table) -> pa.Table:
        columns = {c: [] for c in ("lang", "phrase", "a", "l", "r", "n", "score", "whole_of")}
        if candidates.num_rows:
            depth = longest + 1
            langs, phrases, f = (looked_up.column(c).combine_chunks() for c in ("lang", "phrase", "f"))
            counts = _tree_of(langs, phrases, np.ones(len(f), np.int64), depth)
            counts = _with_counts(*counts, f.to_numpy())
            rows = list(zip(*(candidates.column(c).to_pylist() for c in ("lang", "phrase", "f", "n"))))
            cuts = [[(" ".join(w[:k]), " ".join(w[k:])) for k in range(1, len(w))] for w in (p.split(" ") for _, p, _, _ in rows)]
            parts = sorted({(lang, x) for (lang, *_), cut in zip(rows, cuts) for pair in cut for x in pair})
            weight = _weights_of([p[0] for p in parts], [p[1] for p in parts], counts, depth)
            for (lang, phrase, a, n), cut in zip(rows, cuts):
                pairs = [(weight[lang, x], weight[lang, y]) for x, y in cut]
                score, k = min((1000 * a * n // (x * y), i) for i, (x, y) in enumerate(pairs))  # whole numbers of any size
                inside = [x for x, f in ((cut[-1][0], pairs[-1][0]), (cut[0][1], pairs[0][1])) if f == a and " " in x]
                for c, v in zip(columns, (lang, phrase, a, *pairs[k], n, score, inside)):
                    columns[c].append(v)
        types = {"lang": pa.string(), "phrase": pa.string(), "whole_of": pa.list_(pa.string())}
        return pa.table({c: pa.array(v, types.get(c, pa.int64())) for c, v in columns.items()})

    return run


def _with_counts(tree: Tree, order: np.ndarray, counts: np.ndarray) -> Tree:
    """The same automaton, the count of each phrase on the arc that it ends with."""
    layers = [(label, np.zeros(len(label), np.int64), parent) for label, _, parent in tree.layers]
    for i, (k, arc) in zip(order.tolist(), _ends(tree).tolist()):
        layers[k][1][arc] = counts[i]
    return Tree(tree.words, layers)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n_words, f`` of every phrase of up to ``longest`` words that occurs
    ``least`` times, and ``lang, n``: all words. The counts are written to the shared folder."""
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255: counters are bytes")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    sketch = written(texts.mapInArrow(_sketch(least), SKETCH), "sketch")
    totals = sketch.filter("part is null").groupBy("lang").agg(F.sum("n").alias("n"))
    parts = sketch.filter("part is not null").select("part", "cells").repartition(partitions(spark), "part").mapInArrow(_summed(least), "part int, bits binary")
    frequent = np.zeros((COUNTERS // CELLS, CELLS // 8), np.uint8)
    for row in parts.collect():  # COUNTERS / 8 bytes, whatever the input
        frequent[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    shards = written(texts.mapInArrow(_transducers(frequent.ravel(), longest), "grams long, size long, raw binary"), "transducers")

    ranges = 4 * partitions(spark)
    grams = shards.agg(F.sum("grams")).first()[0] or 0
    step = max(1, grams // (SEEN_A_RANGE * ranges))
    seen = sorted(tuple(r["gram"]) for r in shards.mapInArrow(_seen(step), "gram array<binary>").collect())  # about SEEN_A_RANGE a range
    cuts = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    cut = shards.mapInArrow(_cut([[bytes(w) for w in c] for c in cuts]), "part long, size long, raw binary")
    united = cut.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(_united(least), COUNTS)
    counts = united.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return written(counts, "counts"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` phrases of every language.

    ``docs`` has ``text`` and ``lang``; other columns, whatever their names, are ignored.
    A null text is empty and a null ``lang`` is ``und``. A-Z are lower-cased, pieces end at
    ``. , ; : ! ?`` and line ends, words at spaces and tabs. A phrase is a candidate when it
    has two words or more and occurs ``least`` times inside pieces, overlaps included. Its
    score is that of its lowest-scoring cut, floor(1000 a n / (l r)); ties go to the earliest
    cut. Candidates that are only ever part of one longer candidate are left out. Rows that
    are repeated count each; an empty table gives no rows. Order: score, then ``a``, both
    descending, then the phrase by its bytes.
    """
    spark = docs.sparkSession
    counts, totals = phrase_counts(docs, least, longest)
    found = counts.filter("n_words >= 2")
    groups = max(1, -(-found.count() // GROUP))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("lang", "phrase"), F.lit(groups)).cast("int"))
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), lambda k: F.array(
        F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.col("n_words") - k), " ")))
    asked = dealt.select("part", "lang", F.explode(F.flatten(cuts)).alias("phrase")).distinct()
    looked_up = asked.join(counts.select("lang", "phrase", "f"), ["lang", "phrase"]).select(
        F.col("part").alias("asked_by"), F.col("lang").alias("lang"), F.col("phrase").alias("phrase"), "f")
    given = dealt.join(totals, "lang").select("part", "lang", "phrase", "f", "n")
    scored = written(given.groupBy("part").cogroup(looked_up.groupBy("asked_by")).applyInArrow(_scored(longest), SCORED), "scored")
    # A phrase inside a longer one of the same count is, one word at a time, inside one that is
    # longer by a word.
    inside = scored.select("lang", F.explode("whole_of").alias("phrase")).distinct()
    rank = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rest = scored.drop("whole_of").join(inside, ["lang", "phrase"], "left_anti").withColumn("rank", F.row_number().over(rank))
    return rest.filter(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
