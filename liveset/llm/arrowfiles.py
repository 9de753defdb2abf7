"""Token ids in Arrow files of equal-length sequences.

A shard is one Arrow IPC file whose record batches hold fixed-size lists: ``ids`` (the
narrowest unsigned integer the vocabulary fits), ``mask`` (true where an id is real, false on
the padding that ends a shard) and ``last`` (true where a document ends); masks take a bit. Every batch but the
last has ``BATCH`` sequences, so sequence ``k`` is row ``k % BATCH`` of batch
``k // BATCH``: a memory-mapped reader finds it without copying or scanning. A second file
beside it lists the shard's documents with their place.

Tasks write through Arrow's file systems to the shared folder, under names no other
attempt uses. Which files count is decided by the manifest, a table Spark commits: what a
lost or repeated task wrote is never listed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liveset.llm.common import partitions, written
from liveset.llm.tokens import encoder

LENGTH = 2048
BATCH = 256
PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def narrowest(n_ids: int) -> pa.DataType:
    return pa.uint16() if n_ids <= 1 << 16 else pa.uint32()


class ShardWriter:
    """Streams one shard; holds at most one batch of sequences."""

    def __init__(self, path: str, kind: pa.DataType, length: int, batch: int):
        self.fs, self.path = file_system(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.length, self.room = length, length * batch
        self.ids, self.last = np.zeros(self.room, kind.to_pandas_dtype()), np.zeros(self.room, bool)
        self.kind, self.filled, self.n_tokens, self.n_sequences = kind, 0, 0, 0
        fixed = lambda t: pa.list_(pa.field("item", t, nullable=False), length)
        self.schema = pa.schema([("ids", fixed(kind)), ("mask", fixed(pa.bool_())), ("last", fixed(pa.bool_()))])
        self.stream = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.stream, self.schema)
        self.places_stream = self.fs.open_output_stream(self.path + ".docs")
        self.places_writer = pa.ipc.new_file(self.places_stream, PLACES)
        self.places: list[tuple] = []
        self.n_docs = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.places.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        done = 0
        while done < len(ids):
            take = min(len(ids) - done, self.room - self.filled)
            self.ids[self.filled:self.filled + take] = ids[done:done + take]
            done, self.filled = done + take, self.filled + take
            self.last[self.filled - 1] = done == len(ids)
            if self.filled == self.room:
                self._flush()
        if len(self.places) >= 10_000:
            self._flush_places()

    def _flush(self) -> None:
        rows = -(-self.filled // self.length)
        cut = rows * self.length
        self.ids[self.filled:cut], self.last[self.filled:cut] = 0, False
        mask = np.arange(cut) < self.filled
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip(
            (self.ids[:cut].copy(), mask, self.last[:cut]), self.schema)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_sequences += rows
        self.filled = 0
        self.last[:] = False

    def _flush_places(self) -> None:
        columns = list(zip(*self.places)) or [[]] * 3
        self.places_writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], schema=PLACES))
        self.n_docs += len(self.places)
        self.places = []

    def close(self) -> None:
        if self.filled:
            self._flush()
        self._flush_places()
        for x in (self.writer, self.stream, self.places_writer, self.places_stream):
            x.close()


class ShardReader:
    """Random access to a shard; on a local or mounted path its memory is the file's own."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        open_ = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.file = pa.ipc.open_file(open_(at))
        self.docs = pa.ipc.open_file(open_(at + ".docs"))
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._batch, self._columns = -1, None, {}
        self.batch_rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def column(self, name: str, batch: int) -> np.ndarray:
        """A batch's lists as a matrix. Ids share the file's memory; masks are stored as bits
        and unpacked."""
        if batch != self._at:
            self._at, self._batch, self._columns = batch, self.file.get_batch(batch), {}
        if name not in self._columns:
            column = self._batch.column(self._batch.schema.get_field_index(name))
            self._columns[name] = column.flatten().to_numpy(zero_copy_only=name == "ids").reshape(-1, self.length)
        return self._columns[name]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the shard's sequence ``k``."""
        batch, row = divmod(k, self.batch_rows)
        return self.column("ids", batch)[row], self.column("mask", batch)[row]

    def span(self, start: int, size: int, name: str = "ids") -> np.ndarray:
        """Values ``start`` to ``start + size`` of the shard, across sequences."""
        room, out = self.batch_rows * self.length, []
        while size > 0:
            batch, at = divmod(start, room)
            part = self.column(name, batch).reshape(-1)[at:at + size]
            out.append(part)
            start, size = start + len(part), size - len(part)
        return np.concatenate(out) if len(out) != 1 else out[0]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, length: int = LENGTH,
                 batch: int = BATCH, n_parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``; other columns are ignored) in ascending
    ``doc_id`` order, ``end_id`` after each, and write shards below ``path``. Returns the
    committed manifest: ``part, path, n_docs, n_tokens, n_sequences``.

    Parts are ranges of (doc_id, hash of text), so repeated or null ids do not gather in
    one task. Null ids come first. Null and empty texts hold the end id alone; repeated rows
    are written each; an empty table gives an empty manifest.
    """
    name = uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encode, shard = encoder(tokenizer), None
        kind = narrowest(max(encode.tokenizer.get_vocab_size(), end_id + 1))
        for b in batches:
            ids_of, texts = b.column("doc_id").to_pylist(), b.column("text")
            for begin in range(0, len(texts), 2048):
                for k, ids in enumerate(encode.encode_many(texts.slice(begin, 2048)), begin):
                    if shard is None:
                        shard = ShardWriter(f"{path}/{name}/part-{part:06d}-{attempt}.arrow", kind, length, batch)
                    shard.add(ids_of[k], np.append(ids, np.uint32(end_id)))
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [f"{path}/{name}/part-{part:06d}-{attempt}.arrow"],
                "n_docs": [shard.n_docs], "n_tokens": [shard.n_tokens], "n_sequences": [shard.n_sequences]})

    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = rows.repartitionByRange(n_parts or partitions(spark), *order[:2]).sortWithinPartitions(*order)
    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{path}/{name}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/{name}/manifest")


def shard_starts(manifest: DataFrame) -> list[tuple[str, int]]:
    """Path and first token place of every shard; a manifest has one row per part."""
    out, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        out.append((r["path"], before))
        before += r["n_tokens"]
    return out


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per written document: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), ``whole`` (the file marks an end
    on its last id and nowhere before), from the shard files alone."""
    shards = shard_starts(manifest)
    schema = "doc_id long, start long, n_tokens long, ids binary, whole boolean"
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                shard = ShardReader(path)
                for k in range(shard.docs.num_record_batches):
                    docs = shard.docs.get_batch(k)
                    for begin in range(0, docs.num_rows, 500):
                        some = docs.slice(begin, 500)
                        starts, sizes = some.column("start").to_numpy(), some.column("n_tokens").to_numpy()
                        ids, whole = [], []
                        for s, n in zip(starts, sizes):
                            ids.append(shard.span(s, n).astype("<u4").tobytes())
                            ends = shard.span(s, n, "last")
                            whole.append(bool(ends[-1] and ends.sum() == 1 and shard.span(s, n, "mask").all()))
                        yield pa.RecordBatch.from_arrays([
                            some.column("doc_id"), pa.array(starts + before), pa.array(sizes), pa.array(ids, pa.binary()),
                            pa.array(whole)],
                            names=["doc_id", "start", "n_tokens", "ids", "whole"])

    files = spark.createDataFrame(shards, "path string, before long")
    return files.repartition(len(shards)).mapInArrow(run, schema)
