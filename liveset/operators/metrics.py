"""Counts and reports, always derived from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.dates import show_year
from liveset.functions.text import duration_display
from liveset.scale import side_by_side

SHOW = "show_identifier"


def type_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy(F.coalesce(F.col("type"), F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def corpus_metrics(comments: DataFrame, setlists: DataFrame, processed: DataFrame) -> DataFrame:
    """One row of corpus totals."""
    return side_by_side(
        comments.agg(F.count(F.lit(1)).alias("comments_total"), F.count_distinct(SHOW).alias("shows_with_comments")),
        setlists.agg(F.count(F.lit(1)).alias("setlists_total")),
        processed.agg(F.count(F.lit(1)).alias("shows_attempted")),
    )


def year_counts(processed: DataFrame, totals: DataFrame | None = None, year: Column | None = None) -> DataFrame:
    """Processed items per year and, against given totals, how many remain."""
    counts = processed.groupBy((show_year(SHOW) if year is None else year).alias("year")).agg(
        F.count(F.lit(1)).alias("processed"))
    if totals is None:
        return counts
    done = F.coalesce(F.col("processed"), F.lit(0))
    return totals.join(counts, "year", "left").withColumn("processed", done).withColumn(
        "remaining", F.col("total") - F.col("processed"))


def project_totals(comments: DataFrame, setlists: DataFrame, processed: DataFrame,
                   collection_items: int = fixed.COLLECTION_ITEMS,
                   seconds_per_show: float = fixed.SECONDS_PER_SHOW) -> DataFrame:
    """Volume and time of the full collection, projected from what is in hand."""
    mb = float(1024 * 1024)
    rate = F.when(F.col("shows_processed") > 0, F.col("comments") / F.col("shows_processed")).otherwise(
        float(fixed.DEFAULT_COMMENTS_PER_SHOW))
    n = F.count(F.lit(1))
    return (
        side_by_side(comments.agg(n.alias("comments")), setlists.agg(n.alias("setlists")),
                     processed.agg(n.alias("shows_processed")))
        .withColumn("completion_pct", F.col("shows_processed") / collection_items * 100)
        .withColumn("estimated_comments", F.lit(collection_items) * rate)
        .withColumn("estimated_mb", F.col("estimated_comments") * fixed.BYTES_PER_COMMENT / mb
                    + F.lit(collection_items * fixed.BYTES_PER_SETLIST / mb))
        .withColumn("estimated_comments", F.col("estimated_comments").cast("long"))
        .withColumn("remaining_shows", F.lit(collection_items) - F.col("shows_processed"))
        .withColumn("hours_remaining", F.col("remaining_shows") * seconds_per_show / 3600)
    )


def harvest_progress(songs: DataFrame, done: DataFrame, runs: DataFrame) -> DataFrame:
    """Songs, how many carry lyrics or notes, how many were looked up, and the last run.

    ``songs``: song, lyrics_text, n_interpretations. ``runs``: started_at, limit, fetched, skipped.
    """
    last = F.max_by(F.struct("started_at", "limit", "fetched", "skipped"), "started_at").alias("last_run")
    return side_by_side(
        songs.agg(
            F.count(F.lit(1)).alias("songs_total"),
            F.count_if(F.coalesce(F.col("lyrics_text"), F.lit("")) != "").alias("with_lyrics"),
            F.count_if(F.col("n_interpretations") > 0).alias("with_notes"),
        ),
        done.agg(F.count_distinct("song").alias("songs_done")),
        runs.agg(last),
    )


def status_counts(queue: DataFrame) -> DataFrame:
    """Rows per status; the three standard ones appear even when empty."""
    spark = queue.sparkSession
    base = spark.createDataFrame([(s,) for s in fixed.STATUS_ORDER], "status string").withColumn("n", F.lit(0).cast("long"))
    return queue.select("status", F.lit(1).cast("long").alias("n")).unionByName(base).groupBy("status").agg(F.sum("n").alias("n"))


def ranking_lines(top: DataFrame, rank: str = "rank") -> DataFrame:
    """Markdown table rows of a ranking, one line per row."""
    line = F.format_string(
        "| %d | %s | %s | %s | %s |", F.col(rank), F.col(SHOW), duration_display("duration_seconds"),
        F.col("track_file"), F.coalesce(F.col("source"), F.lit("")))
    return top.select(rank, line.alias("value"))
