"""Merging harvests: reviews, first-wins dedup, upserts, missing and new keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from liveset import fixed
from liveset.functions.text import blank_to_null, clean_html, collapse, first_filled, has_text, is_relevant, strip
from liveset.scale import first_per_key, side_by_side

SHOW = "show_identifier"


# -- reviews and items --------------------------------------------------------
def normalize_reviews(items: DataFrame, keywords: Sequence[str] = fixed.RELEVANT_KEYWORDS) -> DataFrame:
    """One row per review of an item; every review is kept, relevance is only a flag."""
    text = F.coalesce(collapse("r.reviewbody"), F.lit(""))
    return (
        items.select(SHOW, F.posexplode("reviews").alias("review_no", "r"))
        .select(
            SHOW, "review_no",
            F.coalesce(F.col("r.reviewidentifier"), F.lit("")).alias("comment_id"),
            F.coalesce(blank_to_null("r.username"), F.lit(fixed.ANONYMOUS)).alias("reviewer"),
            text.alias("comment_text"), F.col("r.stars").cast("int").alias("rating"),
            F.coalesce(F.col("r.reviewdate"), F.lit("")).alias("created"),
        )
        .withColumn("is_relevant", is_relevant("comment_text", keywords))
    )


def flag_relevant(df: DataFrame, keywords: Sequence[str] = fixed.RELEVANT_KEYWORDS, text: str = "comment_text") -> DataFrame:
    return df.withColumn("is_relevant", is_relevant(text, keywords))


def non_empty(df: DataFrame, text: str) -> DataFrame:
    return df.filter(has_text(text)).withColumn(text, strip(text))


def _one_text(c: str) -> Column:
    """A field that may hold a JSON list, as space-joined text."""
    c = F.col(c)
    return F.when(c.startswith("["), F.coalesce(F.array_join(F.from_json(c, "array<string>"), " "), c)).otherwise(c)


def extended_metadata(items: DataFrame) -> DataFrame:
    """Date, venue, set list text, subjects and credits of an item from its many fields."""
    m = lambda name: f"metadata.{name}"
    subject = F.col(m("subject"))
    parts = F.array_join(
        F.filter(F.array(*[blank_to_null(_one_text(m(c))) for c in ("setlist", "notes", "lineage", "track")]),
                 lambda p: p.isNotNull()), " ")
    plain = lambda name: F.coalesce(F.col(m(name)), F.lit("")).alias(name)
    return items.select(
        SHOW, plain("identifier"), plain("title"),
        first_filled(m("date"), m("performance_date"), m("year"), m("coverage")).alias("date"),
        first_filled(m("venue"), m("location"), m("coverage"), m("spatial")).alias("venue"),
        clean_html(_one_text(m("description"))).alias("description"),
        clean_html(parts).alias("setlist"),
        F.when(subject.startswith("["), F.from_json(subject, "array<string>"))
        .when(subject.isNotNull() & (subject != ""), F.array(subject))
        .otherwise(F.array().cast("array<string>")).alias("subject"),
        *[plain(c) for c in ("creator", "source", "taper", "transferer", "runtime")],
    )


def enrich_shows(shows: DataFrame, extended: DataFrame, order: str | None = None) -> DataFrame:
    """Filled extended fields as a map on existing shows; a later record wins per field."""
    fields = ["taper", "transferer", "runtime", "source"]
    when = F.col(order) if order else F.lit(0)
    pairs = F.array(
        *[F.struct(F.lit(f).alias("k"), blank_to_null(f).alias("v")) for f in fields],
        F.struct(F.lit("subjects").alias("k"),
                 F.when(F.size("subject") > 0, F.to_json("subject")).alias("v")),
    )
    latest = (
        extended.join(shows.select(SHOW), SHOW, "left_semi")
        .select(SHOW, when.alias("_at"), F.explode(pairs).alias("p"))
        .filter("p.v is not null")
        .groupBy(SHOW)
        .agg(*[F.max_by(F.when(F.col("p.k") == f, F.col("p.v")), F.when(F.col("p.k") == f, F.col("_at"))).alias(f)
               for f in [*fields, "subjects"]])
    )
    entries = F.filter(
        F.array(*[F.struct(F.lit(f).alias("k"), F.col(f).alias("v")) for f in [*fields, "subjects"]]),
        lambda e: e["v"].isNotNull(),
    )
    as_map = latest.select(SHOW, F.map_from_entries(entries).alias("extended_metadata"))
    return shows.join(as_map, SHOW, "left")


# -- dedup --------------------------------------------------------------------
def merge_comments(comments: DataFrame, order: Sequence[str] = ("file_no", "pos")) -> DataFrame:
    """First occurrence of each (show, text) over files in order."""
    return first_per_key(comments, [SHOW, "comment_text"], order)


def merge_setlists(setlists: DataFrame, order: Sequence[str] = ("file_no", "pos")) -> DataFrame:
    return first_per_key(setlists, [SHOW], order)


def merge_report(comments: DataFrame, merged: DataFrame, setlists: DataFrame | None = None,
                 shows: DataFrame | None = None) -> DataFrame:
    """One row: rows in, rows out, copies removed, and the merged show counts."""
    parts = [comments.agg(F.count(F.lit(1)).alias("comments_read")), merged.agg(F.count(F.lit(1)).alias("comments_total"))]
    if setlists is not None:
        parts.append(setlists.agg(F.count(F.lit(1)).alias("shows_with_setlists")))
    if shows is not None:
        parts.append(shows.agg(F.count_distinct(SHOW).alias("shows_total")))
    return side_by_side(*parts).withColumn("comments_deduplicated", F.col("comments_read") - F.col("comments_total"))


# -- keys ---------------------------------------------------------------------
def new_items(listing: DataFrame, processed: DataFrame, key: str = SHOW, target: int | None = None,
              order: str | None = None) -> DataFrame:
    """Listed keys not processed yet; with ``target`` the first of them only."""
    fresh = listing.join(processed.select(key), key, "left_anti")
    return fresh if target is None else fresh.orderBy(order or key).limit(target)


def restrict_to(listing: DataFrame, shows: DataFrame, key: str = SHOW) -> DataFrame:
    return listing.join(shows.select(key), key, "left_semi")


def missing_items(processed: DataFrame, setlists: DataFrame, key: str = SHOW, target: int | None = None,
                  order: str | None = None) -> DataFrame:
    """Processed keys whose data is gone, in processing order."""
    return new_items(processed, setlists, key, target, order)


def backfill(processed: DataFrame, existing: DataFrame, parsed: DataFrame, key: str = SHOW) -> DataFrame:
    """Set lists of processed shows: existing ones, else freshly parsed non-empty ones."""
    kept = restrict_to(existing, processed, key)
    added = restrict_to(parsed, processed, key).join(existing.select(key), key, "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def year_status(listing_pages: DataFrame) -> DataFrame:
    """A year is complete only when as many items were read as the source reports."""
    return (
        listing_pages.groupBy("year")
        .agg(F.sum("items_read").alias("items_read"), F.max("num_found").alias("num_found"))
        .withColumn("complete", F.coalesce(F.col("items_read") >= F.col("num_found"), F.lit(False)))
    )


# -- upserts ------------------------------------------------------------------
def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key; combined before the shuffle, so a busy key costs one row per task."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*").select(*rows.columns)
    )


def upsert_comments(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A show with incoming reviews gets them in place of its old ones; others stay."""
    return existing.join(incoming.select(SHOW), SHOW, "left_anti").unionByName(incoming)


def upsert_setlists(existing: DataFrame, incoming: DataFrame, key: str = SHOW) -> DataFrame:
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def apply_decisions(decisions: DataFrame) -> DataFrame:
    return last_wins(decisions, ["song_name"], ["decided_at"])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each group before the shuffle as well."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)
