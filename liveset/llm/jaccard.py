"""Near-duplicate join on word shingles by Bayesian pruning of MinHash candidates.

1. Equal texts are one text from here on, known by the MD5 of their bytes.
2. ``HASHES`` MinHash values per text, cut into bands of ``ROWS``. Two texts of the wanted
   similarity agree on some band but for a chance of (1 - t**ROWS)**BANDS (5e-8 at 0.8).
3. Texts that share a band are compared value by value in growing steps. With a uniform
   prior the posterior of their similarity is a Beta distribution; a pair leaves as soon
   as the chance that it reaches the threshold falls below ``TOLERANCE``.
4. The pairs that stay only say which texts belong together: they go out as a spanning
   forest, one row a text at most, and connected components make small groups of them.
5. Inside a group every pair is pruned again and the rest verified on the exact shingle
   sets. Out go each text's number of links and a spanning forest of them, not the pairs.

Buckets and groups of any size are cut into chunks of about ``CHUNK`` texts, and each pair
of chunks is a piece of work of its own; no list of a group's members or pairs is ever in
one place. Components come from star contractions on the shared folder.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset.llm.common import Carried, Hasher, Words, as_long, components, flat, mixed, runs, shingle_sets, slices, written

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
STEPS = (16, 32, 64, 128)
TOLERANCE = 1e-7
CHUNK, CHUNK_BYTES = 256, 8 << 20
ADDED = ("class_id", "n_copies", "n_links")


def least_matches(threshold: float, steps=STEPS, tolerance: float = TOLERANCE) -> list[int]:
    """Matches among the first n values below which a pair is dropped, for n in ``steps``.

    Values are compared by one byte, so unlike values agree once in 256. After m matches
    of n the posterior chance of at least the threshold is P(Binomial(n + 1, c) <= m).
    """
    c = threshold + (1 - threshold) / 256
    out = []
    for n in steps:
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * c**m * (1 - c) ** (n + 1 - m)
        out.append(m)
    return out


def min_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over a set of shingles, 32 bits each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(out, (x[k:k + 512, None] * a + b).min(axis=0), out=out)
    return out


def one_byte(sig: np.ndarray) -> np.ndarray:
    """A byte of each value that depends on all of its bits: minima of many shingles are
    small numbers, whose upper bits are mostly alike."""
    return (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def _features(batches):
    hasher, rng = Hasher(), np.random.default_rng(4)
    a = rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
    band = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for lo, hi in slices(offsets):
            sets = shingle_sets(Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], hasher), SHINGLE)
            at = [d for d, s in enumerate(sets) if len(s)]
            if not at:
                continue
            sig = np.stack([min_hashes(sets[d], a, b) for d in at])
            wide = sig.reshape(len(at), BANDS, ROWS).astype(np.uint64)
            keys = mixed(mixed(wide[..., 0] << np.uint64(32) | wide[..., 1]) + (wide[..., 2] << np.uint64(32) | wide[..., 3]))
            keys = mixed(keys + band)
            take = pa.array([lo + d for d in at])
            yield pa.RecordBatch.from_arrays([
                batch.column("_rid").take(take), batch.column("_key").take(take), pa.array(np.diff(offsets)[lo:hi][at]),
                pa.array([r.tobytes() for r in one_byte(sig)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), as_long(keys.ravel()))],
                names=["_rid", "key", "n_bytes", "sig", "bands"])


def matrix(column, width: int) -> np.ndarray:
    data, _ = flat(column)
    return data.reshape(-1, width)


def likely(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the pairs stay after every step of the comparison."""
    stay = np.arange(len(left))
    matches, begin = np.zeros(len(left), np.int64), 0
    for n, m in zip(STEPS, least):
        matches[stay] += (sig[left[stay], begin:n] == sig[right[stay], begin:n]).sum(axis=1)
        stay = stay[matches[stay] >= m]
        begin = n
    return stay


def likely_pairs(sig: np.ndarray, chunk: np.ndarray, within: bool, least: list[int]):
    """Pairs of rows that stay, a few rows against all later ones at a time. ``within``: of
    any rows; otherwise only of rows of different chunks."""
    n = len(sig)
    step = max(1, (1 << 16) // max(n, 1))
    for lo in range(0, n - 1, step):
        left, right = np.nonzero(np.arange(n)[None, :] > np.arange(lo, min(lo + step, n - 1))[:, None])
        left = left + lo
        if not within:
            cross = chunk[left] != chunk[right]
            left, right = left[cross], right[cross]
        stay = likely(sig, left, right, least)
        yield left[stay], right[stay]


def roots(n: int, pairs) -> np.ndarray:
    """Smallest row each row is linked to."""
    root = np.arange(n)
    for left, right in pairs:
        while len(left):
            a, b = root[left], root[right]
            differ = a != b
            if not differ.any():
                break
            high, low = np.maximum(a, b)[differ], np.minimum(a, b)[differ]
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
    return root


def _forest(threshold: float):
    least = least_matches(threshold)

    def run(batches):
        for table, starts in runs(batches, ["band", "ci", "cj"]):
            keys, sig = table.column("key"), matrix(table.column("sig"), HASHES)
            chunk, ci, cj = (table.column(c).to_numpy() for c in ("chunk", "ci", "cj"))
            sizes, out = np.diff(starts), []
            for size in np.unique(sizes[sizes > 1]):
                first = starts[:-1][sizes == size]
                if size <= 16:  # all runs of this size at once
                    i, j = np.triu_indices(size, 1)
                    left, right = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                    for k in range(0, len(left), 1 << 18):
                        stay = likely(sig, left[k:k + (1 << 18)], right[k:k + (1 << 18)], least)
                        out.append((left[k + stay], right[k + stay]))
                    continue
                for s in first:
                    root = roots(size, likely_pairs(sig[s:s + size], chunk[s:s + size], ci[s] == cj[s], least))
                    linked = np.flatnonzero(root != np.arange(size))
                    out.append((s + linked, s + root[linked]))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                if len(a):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(a)).combine_chunks(), keys.take(pa.array(b)).combine_chunks()], names=["a", "b"])

    return run


def _verify(threshold: float):
    least = least_matches(threshold)

    def exact(sets, left, right):
        """Which pairs reach the threshold, from the sizes of their sets' intersections."""
        used = np.unique(np.concatenate([left, right]))
        place = np.zeros(len(sets), np.int64)
        place[used] = np.arange(len(used))
        size = np.array([len(sets[d]) for d in used])
        row = np.repeat(np.arange(len(used)), size)
        values, column, count = np.unique(np.concatenate([sets[d] for d in used]), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(used), len(used)), np.float32)
        width = max(256, (1 << 22) // max(len(used), 1))
        n_columns = int(column[-1]) + 1 if len(column) else 0
        for k in range(0, n_columns, width):
            lo, hi = np.searchsorted(column, [k, k + width])
            part = np.zeros((len(used), min(width, n_columns - k)), np.float32)
            part[row[lo:hi], column[lo:hi] - k] = 1
            common += part @ part.T
        both = common[place[left], place[right]].astype(np.int64)
        return both >= threshold * (size[place[left]] + size[place[right]] - both) - 1e-9

    def run(batches):
        hasher = Hasher()
        for table, starts in runs(batches, ["comp", "ci", "cj"]):
            keys, sig = table.column("key"), matrix(table.column("sig"), HASHES)
            chunk, ci, cj = (table.column(c).to_numpy() for c in ("chunk", "ci", "cj"))
            data, offsets = flat(table.column("text"))
            links, root_of = np.zeros(len(keys), np.int64), np.arange(len(keys))
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s < 2:
                    continue
                sets = []
                for lo, hi in slices(offsets[s:e + 1]):
                    cut = offsets[s + lo:s + hi + 1]
                    sets += shingle_sets(Words(data[cut[0]:cut[-1]], cut - cut[0], hasher), SHINGLE)

                def verified(s=s, e=e, sets=sets):
                    for left, right in likely_pairs(sig[s:e], chunk[s:e], ci[s] == cj[s], least):
                        if len(left):
                            good = exact(sets, left, right)
                            left, right = left[good], right[good]
                            np.add.at(links, s + left, 1)
                            np.add.at(links, s + right, 1)
                        yield left, right

                root_of[s:e] = s + roots(e - s, verified())
            yield pa.RecordBatch.from_arrays(
                [keys.combine_chunks(), keys.take(pa.array(root_of)).combine_chunks(), pa.array(links)], names=["a", "b", "n_links"])

    return run


def _in_chunks(df: DataFrame, group: str, n_chunks: Column) -> DataFrame:
    """Each row once for every pair of chunks its own chunk is in, sorted by these pairs."""
    chunk = F.pmod(F.xxhash64("key", F.lit(7)), F.col("_n")).cast("int")
    df = df.withColumn("_n", n_chunks.cast("long")).withColumn("chunk", chunk)
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    df = df.withColumn("ci", F.least("chunk", "_other")).withColumn("cj", F.greatest("chunk", "_other")).drop("_n", "_other")
    return df.repartition(group, "ci", "cj").sortWithinPartitions(group, "ci", "cj")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``key`` (MD5 of a text), ``root`` (of all texts it is linked to, directly or not) and
    ``n_links`` (different texts at least ``threshold`` similar) of every text with a link.
    Needs ``text`` and ``_rid``, an id of the row."""
    rows = docs.select("_rid", "text", F.unhex(F.md5("text")).alias("_key"))
    features = rows.filter("text is not null").mapInArrow(_features, "_rid long, key binary, n_bytes long, sig binary, bands array<long>")
    features = features.groupBy("key").agg(F.min_by(F.struct("_rid", "n_bytes", "sig", "bands"), "_rid").alias("f")).select("key", "f.*")
    features = written(features, "minhash")

    bands = features.select("key", F.explode("bands").alias("band"))
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = bands.join(full, "band").join(features.select("key", "sig"), "key")
    buckets = _in_chunks(members.withColumn("n", F.ceil(F.col("n") / CHUNK)), "band", F.col("n"))
    candidates = buckets.select("band", "ci", "cj", "chunk", "key", "sig").mapInArrow(_forest(threshold), "a binary, b binary")
    groups = written(components(candidates).select(F.col("node").alias("key"), F.col("root").alias("comp")), "groups")

    known = features.select("_rid", "key", "sig", "n_bytes").join(groups, "key")
    sizes = known.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"))
    n_chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES))
    texts = known.join(sizes.select("comp", n_chunks.alias("n")), "comp").join(rows.select("_rid", "text"), "_rid")
    blocks = _in_chunks(texts, "comp", F.col("n"))
    verified = written(blocks.select("comp", "ci", "cj", "chunk", "key", "sig", "text").mapInArrow(
        _verify(threshold), "a binary, b binary, n_links long"), "links")
    linked = verified.groupBy("a").agg(F.sum("n_links").alias("n_links")).filter("n_links > 0").select(F.col("a").alias("key"), "n_links")
    return linked.join(components(verified.select("a", "b")).select(F.col("node").alias("key"), "root"), "key")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``class_id`` (smallest ``doc_id`` of all documents it is linked to,
    directly or through others; its own if none), ``n_copies`` (rows of its very text) and
    ``n_links`` (different texts similar to it). Same-named columns are replaced.

    Similarity is the Jaccard index of sets of five-word shingles; words are runs of
    characters other than ASCII white space, unchanged. Shorter texts are one shingle.
    Texts without a word, and null texts, are linked to nothing and are in a class of their
    own, so equal ones keep their own ``doc_id`` as class. Equal texts and repeated rows
    are in one class. A class whose ids are all null has a null ``class_id``. ``docs`` is
    read more than once and must give the same rows in the same partitions, as files do.
    """
    carried = Carried(docs, ("doc_id", "text"), ADDED)
    docs = carried.df
    classes = text_classes(docs.withColumn("_rid", F.monotonically_increasing_id()), threshold)
    word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.withColumn("_key", F.when(word, F.unhex(F.md5("text"))))
    per_text = keyed.filter("_key is not null").groupBy("_key").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("n_copies"))
    per_text = per_text.join(classes, per_text["_key"] == classes["key"], "left").select(
        "_key", "_least", "n_copies", "n_links", F.coalesce("root", "_key").alias("_root"))
    least = per_text.groupBy("_root").agg(F.min("_least").alias("class_id"))
    info = per_text.join(least, "_root").select("_key", "class_id", "n_copies", "n_links")
    out = keyed.join(info, "_key", "left")
    return out.select(
        *carried.columns(), F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of every class of near duplicates, with all columns: the smallest ``doc_id``,
    null ids last, the first row of equal ids. Rows without a word in their text stay all."""
    carried = Carried(docs, ("doc_id", "text"))
    rows = carried.df.withColumn("_rid", F.monotonically_increasing_id())
    classes = text_classes(rows.select("_rid", "text"), threshold)
    word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = rows.filter(word).select("_rid", "doc_id", F.unhex(F.md5("text")).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("best"))
    rooted = first.join(classes, first["_key"] == classes["key"], "left").select(F.coalesce("root", "_key").alias("_root"), "best")
    kept = rooted.groupBy("_root").agg(F.min("best").alias("best")).select(F.col("best._rid").alias("_rid"))
    marked = rows.filter(word).join(kept, "_rid", "left_semi").select(*carried.columns())
    return marked.union(carried.df.filter(~word).select(*carried.columns()))


def brute_force(texts: list[str | None], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """For tests: per text the smallest index of its class and its number of links to
    different texts."""
    import re

    split = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    sets = [({w[k:k + SHINGLE] for k in range(len(w) - SHINGLE + 1)} or {w}) if w else set() for w in split]
    root, links = list(range(len(texts))), [set() for _ in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                if texts[i] != texts[j]:
                    links[i].add(texts[j])
                    links[j].add(texts[i])
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(find(k), len(links[k])) for k in range(len(texts))]
