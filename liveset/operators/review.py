"""Review queue of inferred singers: queue, page, tag choice, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.text import blank_to_null, strip
from liveset.scale import row_ordinal


def status_rank(status: Column | str) -> Column:
    """Queue rank of a status; an unknown one ranks as pending."""
    status = F.col(status) if isinstance(status, str) else status
    table = F.create_map(*[F.lit(x) for pair in fixed.STATUS_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(0))


def review_queue(staging: DataFrame, decisions: DataFrame, key: str = "song_name") -> DataFrame:
    """Staged rows under their decisions: the decision's status, else the staged one."""
    decided = decisions.select(key, F.col("status").alias("_decided"))
    staged = F.col("status") if "status" in staging.columns else F.lit(None).cast("string")
    return (
        staging.join(decided, key, "left")
        .withColumn("status", F.coalesce("_decided", staged, F.lit("pending")))
        .drop("_decided").withColumn("status_rank", status_rank("status"))
    )


def review_page(queue: DataFrame, order: list[str], page: int = 1, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """One page of pending rows. The page number is held within the pages there are."""
    pending = queue.filter(F.col("status") == "pending")
    pages = max(1, -(-pending.count() // size))
    page = min(max(1, page), pages)
    return pending.orderBy(*order).offset((page - 1) * size).limit(size)


def numbered_pages(queue: DataFrame, order: list[str], size: int = fixed.PAGE_SIZE, **kw) -> DataFrame:
    """Every pending row with its page number and place, for paging without a limit."""
    pending = queue.filter(F.col("status") == "pending")
    placed = row_ordinal(pending, ["status"], order, "place", **kw)
    return placed.withColumn("page", F.ceil(F.col("place") / size).cast("int"))


def resolve_tags(actions: DataFrame, staging: DataFrame) -> DataFrame:
    """Tag and singer a reviewer's choice stands for.

    Tried in turn, ignoring case: the recommended tag, an alternate by name or tag in
    listed order, the primary singer by name. Alternates sit in the row, so nothing is
    exploded or shuffled for the choice itself.
    """
    rows = actions.join(staging, "song_name", "left")
    wanted = F.lower(strip(F.coalesce(blank_to_null("chosen"), F.col("tag"), F.lit(""))))
    empty = F.lit("")
    singer = F.coalesce("primary_vocalist", empty)
    pick = lambda t, v: F.struct(t.alias("resolved_tag"), v.alias("resolved_vocalist"))
    alternates = F.filter("plausible_singers", lambda a: (F.lower(F.coalesce(a["name"], empty)) == wanted)
                          | (F.lower(F.coalesce(a["tag"], empty)) == wanted))
    alternate = F.get(alternates, F.lit(0))
    choice = F.coalesce(
        F.when((F.coalesce("tag", empty) != "") & (wanted == F.lower("tag")), pick(F.col("tag"), singer)),
        F.when(alternate.isNotNull(), pick(alternate["tag"], F.coalesce(alternate["name"], empty))),
        F.when(wanted == F.lower(singer), pick(F.coalesce("tag", wanted), singer)),
    )
    return rows.withColumn("_c", choice).select(*actions.columns, "canonical_title", "_c.*")


def promote_tags(lyrics: DataFrame, promotions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lyrics with ``[tag]`` put in front, and the promotions that could not be applied: no
    tag, unknown song, tag already there.

    A song carries few distinct tags, one a singer; repeats of a promotion count once. Tags
    of one song go in front of each other in the order of ``decided_at`` (the first of
    equal promotions), then of the tag; without that column in the order of the tag.

    ``lyrics``: title, lyrics_text. ``promotions``: song_name, canonical_title, tag. The
    canonical title is looked up first, then the song name.
    """
    if "decided_at" not in promotions.columns:
        promotions = promotions.withColumn("decided_at", F.lit(None).cast("string"))
    untagged = promotions.filter(blank_to_null("tag").isNull())
    promotions = promotions.filter(blank_to_null("tag").isNotNull())
    titles = lyrics.select("title")
    canonical = F.coalesce(blank_to_null("canonical_title"), F.col("song_name"))
    by_title = promotions.withColumn("title", canonical).join(titles, "title", "left_semi")
    rest = promotions.withColumn("title", canonical).join(titles, "title", "left_anti")
    by_name = rest.withColumn("title", F.col("song_name")).join(titles, "title", "left_semi")
    unknown = rest.join(titles.select(F.col("title").alias("song_name")), "song_name", "left_anti")
    found = by_title.unionByName(by_name)
    text = F.coalesce("lyrics_text", F.lit(""))
    head = F.concat(F.lit("["), F.col("tag"), F.lit("]"))
    tagged = found.select("song_name", "title", "tag", "decided_at").join(lyrics.select("title", "lyrics_text"), "title").withColumn(
        "has_tag", strip(text).startswith(head))
    # Each tag goes in front of the earlier ones.
    fresh = tagged.filter(~F.col("has_tag")).groupBy("title", "tag").agg(F.min("decided_at").alias("decided_at"))
    heads = fresh.groupBy("title").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("decided_at", "tag")), asc=False), lambda x: x["tag"]).alias("tags"))
    front = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("["), t, F.lit("]\n\n"))), "")
    updated = lyrics.join(heads, "title", "left").withColumn(
        "lyrics_text", F.when(F.col("tags").isNotNull(), F.concat(front, text)).otherwise(F.col("lyrics_text"))
    ).drop("tags")
    errors = (
        tagged.filter("has_tag").select("song_name", "tag", F.lit("already tagged").alias("error"))
        .unionByName(unknown.select("song_name", "tag", F.lit("song not found").alias("error")))
        .unionByName(untagged.select("song_name", "tag", F.lit("no tag").alias("error")))
    )
    return updated, errors
