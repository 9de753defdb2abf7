"""Helpers that keep plans whole and even when keys are skewed.

* ``checkpoint``      cut lineage on the shared folder, so lost executors cost nothing
* ``collect_bounded`` bring a small side to the driver only after its size is proven
* ``running_sum``, ``row_ordinal``, ``previous_value``
                      ordered per-key results; a key too big for one task is cut into
                      ranges, solved per range and stitched with per-range offsets
* ``salted_join``     equi join in which keys on many rows are split over tasks
* ``first_per_key``   first-wins dedup through a map-side combined minimum
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HASH_BUCKETS = 1 << 16
HOT_ROWS = 2_000_000
CHUNK = "_chunk"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="liveset-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/liveset-{uuid.uuid4().hex}/{name}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise on reliable shared storage; the result has no lineage to recompute."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, max_rows: int) -> list | None:
    """Rows of ``df`` when there are at most ``max_rows``; ``None`` when there are more."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def key_bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS))


def hot_buckets(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hash buckets whose rows would overload one task.

    One pass over the key columns, combined before the shuffle to at most
    ``HASH_BUCKETS`` counters, which is also the most that can be returned. A bucket is hot
    by its own rows alone, however large the table is.
    """
    counts = df.groupBy(key_bucket(keys).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["bucket"] for r in counts.filter(F.col("n") > hot_rows).select("bucket").collect())


def _split(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int, hot: list[int] | None):
    """Rows of ordinary keys, and rows of overfull ones with ``_chunk``, a range number that
    follows ``order``; the second is ``None`` when no key is overfull.

    ``hot`` are buckets already found on a frame that has at least the rows of ``df`` per
    key, such as the table ``df`` was made from; that frame is the cheaper one to count.
    """
    if hot is None:
        hot = hot_buckets(df, keys, hot_rows)
    if not hot:
        return df, None
    spark = df.sparkSession
    marks = F.broadcast(spark.createDataFrame([(b,) for b in hot], "_bucket long"))  # HASH_BUCKETS at most
    tagged = df.withColumn("_bucket", key_bucket(keys))
    ordinary = tagged.join(marks, "_bucket", "left_anti").drop("_bucket")
    ranged = tagged.join(marks, "_bucket", "left_semi").drop("_bucket").repartitionByRange(
        int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order
    )
    # The range number must not change between the uses below, hence the checkpoint.
    return ordinary, checkpoint(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _attach(df: DataFrame, per_range: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join what is known per key and range; a null key is a key like any other."""
    by = [*keys, CHUNK]
    right = per_range.select(*[F.col(k).alias(f"_r_{k}") for k in by], *[c for c in per_range.columns if c not in by])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"_r_{k}"]) for k in by])
    return df.join(right, same).drop(*[f"_r_{k}" for k in by])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str,
                out: str, hot_rows: int = HOT_ROWS, hot: list[int] | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per key; ``order`` must be unique in a key."""
    keys, order = list(keys), list(order)
    value = F.col(value) if isinstance(value, str) else value
    ordinary, ranged = _split(df, keys, order, hot_rows, hot)
    so_far = lambda *by: F.sum(value).over(
        W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    plain = ordinary.withColumn(out, so_far(*keys))
    if ranged is None:
        return plain
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    stitched = _attach(ranged.withColumn(out, so_far(*keys, CHUNK)), offsets, keys).withColumn(
        out, F.col(out) + F.col("_offset"))
    return plain.unionByName(stitched.select(*df.columns, out))


def row_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
                hot_rows: int = HOT_ROWS, hot: list[int] | None = None) -> DataFrame:
    """1-based ordinal per key."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, hot_rows, hot)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   out: str, hot_rows: int = HOT_ROWS, hot: list[int] | None = None) -> DataFrame:
    """``value`` of the preceding row of the key; null on its first row."""
    keys, order = list(keys), list(order)
    ordinary, ranged = _split(df, keys, order, hot_rows, hot)
    plain = ordinary.withColumn(out, F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))
    if ranged is None:
        return plain
    boxed = F.struct(F.col(value).alias("v"))
    carried = (
        ranged.groupBy(*keys, CHUNK).agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy(CHUNK)))
        .drop("_last")
    )
    here = ranged.withColumn("_here", F.lag(boxed).over(W.partitionBy(*keys, CHUNK).orderBy(*order)))
    stitched = _attach(here, carried, keys).withColumn(out, F.coalesce(F.col("_here"), F.col("_carry"))["v"])
    return plain.unionByName(stitched.select(*df.columns, out))


def salt_marks(many: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, rows: str | None = None) -> DataFrame:
    """Overfull hash buckets and the salts each is dealt over. Rows are counted in
    ``HASH_BUCKETS`` counters, combined before the shuffle, so as many rows are broadcast at
    most. ``rows`` names a column of ``many`` that holds counts made before."""
    number = F.count(F.lit(1)) if rows is None else F.sum(rows)
    counts = many.groupBy(key_bucket(keys).alias("bucket")).agg(number.alias("n")).filter(F.col("n") > hot_rows)
    return F.broadcast(many.sparkSession.createDataFrame([(r["bucket"], -(-r["n"] // hot_rows)) for r in counts.collect()], "_bucket long, _parts long"))


def deal(many: DataFrame, marks: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``_salt``: those of marked buckets are dealt over their salts, others have 0.

    ``by`` are columns that tell rows apart: the salt follows from them, so a repeated task
    deals alike in whatever order its rows come. Without them it follows from the row's place.
    """
    place = [F.col(c) for c in by] or [F.monotonically_increasing_id()]
    return many.withColumn("_bucket", key_bucket(keys)).join(marks, "_bucket", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*place), F.coalesce("_parts", F.lit(1)))).drop("_bucket", "_parts")


def copy_over(few: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The partners of dealt rows: copied once a salt of their bucket."""
    return few.withColumn("_bucket", key_bucket(keys)).join(marks, "_bucket", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_bucket", "_parts")


def salted(many: DataFrame, few: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with ``_salt``. A bucket of ``many`` with more than ``hot_rows`` is
    dealt over as many salts as bring it below that, and the rows of ``few`` in it are copied
    once a salt; all other rows have the salt 0 and are copied nowhere."""
    marks = salt_marks(many, keys, hot_rows)
    return deal(many, marks, keys), copy_over(few, marks, keys)


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join on ``keys``; a key that holds much of ``many`` is shared by several tasks."""
    dealt, copied = salted(many, few, keys, hot_rows)
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key, for long keys; ``order`` must identify a row.

    The key travels as a digest and each mapper sends one candidate per key, so neither
    long texts nor a group of copies that makes up much of the table is gathered.
    """
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    keep = df.select(digest.alias("_key"), at.alias("_order")).groupBy("_key").agg(F.min("_order").alias("_order"))
    keep = keep.select(F.col("_order").alias(order[0])) if len(order) == 1 else keep.select("_order.*")
    return df.join(keep, list(order), "left_semi")


def first_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same for short rows: one shuffle of one candidate per key and mapper."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames as one row, without joining them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames)
    return stacked.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in stacked.columns])
