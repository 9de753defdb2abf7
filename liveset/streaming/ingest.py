"""Resumable ingestion: landed files to keyed tables through Structured Streaming.

Each micro-batch writes its rows under ``batch_id=N``. A replayed batch overwrites its own
folder, so a crash between writing and checkpointing leaves no doubles; nothing already
stored is rewritten. Readers resolve keys on read, and ``compact`` folds the log into a
table kept by key, of which it rewrites the touched buckets only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from liveset.operators.merge import SHOW, last_wins, normalize_reviews
from liveset.sources import schemas
from liveset.sources.sinks import numbered_folders
from liveset.streaming.keyed import BUCKETS, fold, listing, read_keyed

BATCH = "batch_id"


def stream_json(spark: SparkSession, path: str, schema: str = schemas.ITEMS, files_per_batch: int | None = None) -> DataFrame:
    """Landed JSON files; a batch takes all that are new unless ``files_per_batch`` says less."""
    return _paced(spark.readStream.schema(schema).option("multiLine", True), files_per_batch).json(path)


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    return _paced(spark.readStream.schema(schema), files_per_batch).parquet(path)


def _paced(reader, files_per_batch: int | None):
    return reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")


def ingest_stream(source: DataFrame, log: dict[str, str], checkpoint: str,
                  transforms: dict[str, Callable[[DataFrame], DataFrame]]) -> StreamingQuery:
    """Run a stream over everything that has landed; a later run continues from there.

    ``transforms`` maps a table name to what it makes of a batch, ``log`` to its folder.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            for name, transform in transforms.items():
                _write_batch(transform(df), batch_id, log[name])
        finally:
            df.unpersist()

    return (
        source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def item_transforms() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Tables kept from item documents: reviews and processed keys."""
    keyed = lambda items: items.withColumn(SHOW, F.col("metadata.identifier"))
    return {
        "reviews": lambda items: normalize_reviews(keyed(items)),
        "processed": lambda items: keyed(items).select(SHOW),
    }


def batches(spark: SparkSession, path: str) -> list[int]:
    """Stored batches, by their folders' names."""
    return numbered_folders(spark, path, BATCH)


def read_log(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """Stored batches, all or some; ``batch_id`` comes from the folder names."""
    folders = ["*"] if only is None else only
    return spark.read.option("basePath", path).parquet(*[f"{path.rstrip('/')}/{BATCH}={b}" for b in folders])


def replace_by_key(log: DataFrame, keys: Sequence[str] = (SHOW,)) -> DataFrame:
    """Rows of the latest batch that brought any for their key.

    A batch without rows for a key changes nothing for it, so re-reading a show without
    reviews keeps the old ones.
    """
    latest = log.groupBy(*keys).agg(F.max(BATCH).alias(BATCH))
    return log.join(latest, [*keys, BATCH], "left_semi")


def upsert_by_key(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by batch and ``order``."""
    return last_wins(log, keys, [BATCH, *order])


def compact(spark: SparkSession, log_path: str, table_path: str, keys: Sequence[str] = (SHOW,), buckets: int = BUCKETS) -> DataFrame | None:
    """Fold the batches not folded yet into a table kept by key (``streaming/keyed.py``).

    Only the buckets that hold a key of these batches are rewritten. The last batch is noted
    with the version that holds it, so a fold that dies is repeated with the same result.
    """
    state = listing(spark, table_path)
    fresh = [b for b in batches(spark, log_path) if state is None or b > state.upto]
    if fresh:
        fold(replace_by_key(read_log(spark, log_path, fresh), keys).drop(BATCH), table_path, keys, fresh[-1], buckets)
    return read_keyed(spark, table_path)


def new_keys_only(source: DataFrame, processed: DataFrame, key: str = SHOW) -> DataFrame:
    """Stream rows of keys a table does not hold yet; the table bounds the state. Every batch
    reads the table's keys; ``keyed.ingest_new`` reads those it cannot tell apart by filters."""
    return source.join(processed.select(key).distinct(), key, "left_anti")
