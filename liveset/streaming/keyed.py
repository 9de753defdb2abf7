"""Tables kept by key in hash buckets, with Bloom filters of the keys beside them.

A batch rewrites the buckets it touches and leaves the files of all others alone. Layout::

    rows/fold=V/_key_bucket=B/     the whole bucket B as of fold V
    filters/fold=V/_key_bucket=B/  bits of the bucket's keys, in blocks of 32,768
    version=V/                     which fold holds each bucket now; its commit is the fold's

Readers see the last committed listing, so a fold that dies leaves files nobody lists, and a
repeated one overwrites them. Filters never lose a key: no bit means the key is new, and only
keys with all bits set are compared with stored rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from liveset.scale import checkpoint
from liveset.sources.sinks import publish, versions

BUCKET = "_key_bucket"
BLOCK_BITS = 32_768  # one bitmap of Spark's bitmap functions
BUCKETS = 256
BLOCKS = 16  # a bucket: 10 bits a key for 50,000 keys; more keys mean more exact checks, no other result
HASHES = 7
BITS = [f"_bit{i}" for i in range(HASHES)]


class Listing(NamedTuple):
    version: int
    folds: dict[int, int]  # bucket to the fold that holds it
    buckets: int
    blocks: int
    upto: int


def listing(spark: SparkSession, path: str) -> Listing | None:
    """The current state of a table; at most one row a bucket is fetched."""
    done = versions(spark, path)
    if not done:
        return None
    rows = spark.read.parquet(f"{path.rstrip('/')}/version={done[-1]}").collect()
    return Listing(done[-1], {r["bucket"]: r["fold"] for r in rows}, rows[0]["buckets"], rows[0]["blocks"], rows[0]["upto"])


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str, kind: str, state: Listing, only: Sequence[int] | None = None) -> DataFrame | None:
    """Current rows or filters of all buckets, or of those in ``only``."""
    wanted = state.folds if only is None else [b for b in only if b in state.folds]
    paths = [f"{path.rstrip('/')}/{kind}/fold={state.folds[b]}/{BUCKET}={b}" for b in wanted]
    return spark.read.parquet(*paths) if paths else None


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """All current rows; ``None`` before the first fold."""
    state = listing(spark, path)
    return None if state is None else _stored(spark, path, "rows", state)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which a null key is a key like any other."""
    other = right.select(*[F.col(k).alias(f"_o_{k}") for k in keys])
    return left.join(other, reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_o_{k}"]) for k in keys]), how)


def _hashed(keyed: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """Keys with the block of their bucket's filter and the bits they set in it."""
    at = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)).cast("int")
    return keyed.select("*", at(-1, blocks).alias("block"), *[at(i, BLOCK_BITS).alias(b) for i, b in enumerate(BITS)])


def fold(rows: DataFrame, path: str, keys: Sequence[str], upto: int | None = None,
         buckets: int = BUCKETS, blocks: int = BLOCKS) -> bool:
    """Let ``rows`` replace the stored rows of their keys; False if there was nothing to do.

    Several rows may share a key and all stay. ``upto`` is the number of the last batch in
    ``rows``: a batch that is not above the number noted last has been folded and is left
    out. ``buckets`` and ``blocks`` count for the first fold; later ones keep them. Spark
    splits a bucket that is far larger than others over several writing tasks.
    """
    spark, root = rows.sparkSession, path.rstrip("/")
    state = listing(spark, path)
    if state is not None:
        buckets, blocks = state.buckets, state.blocks
        if upto is not None and upto <= state.upto:
            return False
    fresh = checkpoint(rows.withColumn(BUCKET, _bucket(keys, buckets)))
    touched = [r[BUCKET] for r in fresh.select(BUCKET).distinct().collect()]  # ``buckets`` at most
    if not touched:
        return False
    version = 1 if state is None else state.version + 1
    keyed = fresh.select(*keys, BUCKET).distinct()
    bits = _hashed(keyed, keys, blocks).select(
        BUCKET, "block", F.explode(F.array(*BITS)).alias("bit")).groupBy(BUCKET, "block").agg(
        F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
    stored = None if state is None else _stored(spark, path, "rows", state, touched)
    if stored is not None:
        kept = _same(stored, keyed, keys, "left_anti").withColumn(BUCKET, _bucket(keys, buckets))
        fresh = kept.unionByName(fresh)
        old = _stored(spark, path, "filters", state, touched).select(F.col("bucket").alias(BUCKET), "block", "bits")
        bits = old.unionByName(bits).groupBy(BUCKET, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    write = lambda df, kind: (
        df.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/{kind}/fold={version}"))
    write(fresh, "rows")
    write(bits.withColumn("bucket", F.col(BUCKET)), "filters")
    folds = {**({} if state is None else state.folds), **dict.fromkeys(touched, version)}
    noted = upto if upto is not None else (-1 if state is None else state.upto)
    listed = [(b, f, buckets, blocks, noted) for b, f in sorted(folds.items())]
    publish(spark.createDataFrame(listed, "bucket int, fold int, buckets int, blocks int, upto long").coalesce(1), path, version)
    return True


def _maybe(keyed: DataFrame, filters: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """Keys with all their bits set."""
    octet = lambda b: F.conv(F.hex(F.substring("bits", (F.col(b) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda b: F.expr(f"1 = (shiftright(_octet{b}, {b} % 8) & 1)")
    met = _hashed(keyed, keys, blocks).join(filters.withColumnRenamed("bucket", BUCKET), [BUCKET, "block"])
    met = met.select(*keys, BUCKET, *BITS, *[octet(b).alias(f"_octet{b}") for b in BITS])
    return met.filter(reduce(lambda a, b: a & b, [is_set(b) for b in BITS])).select(*keys, BUCKET)


def unseen(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the table does not hold.

    The filters of the buckets that the keys fall into tell most new keys apart. The rest
    is compared exactly with the stored keys of its own buckets; where nothing is left, no
    stored row is read.
    """
    spark = rows.sparkSession
    state = listing(spark, path)
    if state is None:
        return rows
    keyed = rows.select(*keys).distinct().withColumn(BUCKET, _bucket(keys, state.buckets))
    touched = [r[BUCKET] for r in keyed.select(BUCKET).distinct().collect()]  # ``buckets`` at most
    filters = _stored(spark, path, "filters", state, touched)
    if filters is None:
        return rows
    maybe = checkpoint(_maybe(keyed, filters, keys, state.blocks))
    doubtful = [r[BUCKET] for r in maybe.select(BUCKET).distinct().collect()]
    if not doubtful:
        return rows
    known = _same(maybe, _stored(spark, path, "rows", state, doubtful), keys, "left_semi")
    return _same(rows, known, keys, "left_anti")


def ingest_new(source: DataFrame, path: str, stream_checkpoint: str, keys: Sequence[str],
               transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Run a stream whose rows of keys not stored before join the table, batch by batch.

    A replayed batch that was folded is left out by its number; one that was not is worked
    on anew and gives the same rows.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        state = listing(df.sparkSession, path)
        if state is None or batch_id > state.upto:
            fold(transform(unseen(df, path, keys)), path, keys, batch_id)

    return (
        source.writeStream.foreachBatch(batch).option("checkpointLocation", stream_checkpoint)
        .trigger(availableNow=True).start()
    )
