"""Song catalogue: mention counts, canonical names, fuzzy matches, posts, merged entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.similarity import matching_ratio
from liveset.functions.text import (
    cap, clean_song_title, col, collapse, is_song_length, is_song_noise, song_key, strip, unescape, words,
)
from liveset.operators.merge import top_per_key
from liveset.scale import checkpoint

NAME, MENTIONS = "name", "setlist_mentions"


# -- mention counts -----------------------------------------------------------
def song_mentions(songs: DataFrame, name: str = "song_name", weight: Column | None = None, decode=unescape) -> DataFrame:
    """Cleaned song names with their mention counts, noise lines dropped.

    Counts per raw name first, so cleaning runs once per distinct spelling.
    """
    weight = F.lit(1) if weight is None else weight
    raw = (
        songs.select(strip(name).alias("raw"), weight.cast("long").alias("w"))
        .filter(F.col("raw") != "").groupBy("raw").agg(F.sum("w").alias("w"))
    )
    return (
        raw.filter(~is_song_noise("raw"))
        .select(clean_song_title("raw", decode).alias(NAME), "w")
        .filter(is_song_length(NAME))
        .groupBy(NAME).agg(F.sum("w").alias(MENTIONS))
    )


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.SONG_ALIASES.items()), "song_key string, alias_key string")


def with_match_key(songs: DataFrame, name: str = NAME, decode=unescape) -> DataFrame:
    """Song key with verified aliases applied."""
    table = F.create_map(*[F.lit(x) for pair in fixed.SONG_ALIASES.items() for x in pair])
    key = song_key(name, decode)
    return songs.withColumn("match_key", key).withColumn(
        "match_key", F.coalesce(F.try_element_at(table, F.col("match_key")), F.col("match_key")))


def match_canonical(songs: DataFrame, index: DataFrame, name: str = NAME, cutoff: float = fixed.FUZZY_CUTOFF,
                    decode=unescape) -> DataFrame:
    """Slug of every song name: exact key first, close key otherwise; null where neither fits.

    ``index``: song_key, slug. Keys are matched once per distinct key, then joined back.
    Names are few next to their mentions, so they are materialised once: three uses below
    would otherwise count the mentions three times.
    """
    keyed = checkpoint(with_match_key(songs, name, decode))
    keys = keyed.select("match_key").distinct()
    exact = keys.join(index.select(F.col("song_key").alias("match_key"), "slug"), "match_key").withColumn(
        "match", F.lit("exact"))
    rest = keys.join(index.select(F.col("song_key").alias("match_key")), "match_key", "left_anti")
    if rest.isEmpty():
        return keyed.join(exact, "match_key", "left")
    close = fuzzy_match(rest.select(F.col("match_key").alias("left_key")),
                        index.select(F.col("song_key").alias("right_key"), "slug"), cutoff)
    close = close.select(F.col("left_key").alias("match_key"), "slug", F.lit("fuzzy").alias("match"))
    return keyed.join(exact.unionByName(close), "match_key", "left")


# -- fuzzy names --------------------------------------------------------------
def _max_other_length(a: Column, cutoff: float) -> Column:
    return F.floor(a * ((2 - cutoff) / cutoff) + 1e-9).cast("int")


def _max_edits(total: Column, cutoff: float) -> Column:
    return F.floor(total * (1 - cutoff) + 1e-9).cast("int")


def fuzzy_match(left: DataFrame, right: DataFrame, cutoff: float = fixed.FUZZY_CUTOFF) -> DataFrame:
    """Best right key per left key with ratio >= ``cutoff``; ties take the largest key.

    Lossless blocking: at this ratio two names differ by at most k inserted or deleted
    characters, so of k + 1 pieces of the left key one stands unchanged in the right key,
    shifted by at most k. Pieces meet right substrings by an equi join on piece and place;
    the ratio is computed on those pairs only. Columns: left_key; right_key and any more.
    """
    extra = [c for c in right.columns if c != "right_key"]
    a = F.length("left_key")
    longest = _max_other_length(a, cutoff)
    k = _max_edits(a + longest, cutoff)
    pieces = (
        left.select("left_key").distinct().filter(a > 0)
        .withColumn("k", F.least(k, a - 1))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("from", F.floor(F.col("piece_no") * a / (F.col("k") + 1)).cast("int"))
        .withColumn("to", F.floor((F.col("piece_no") + 1) * a / (F.col("k") + 1)).cast("int"))
        .select("left_key", F.substring("left_key", F.col("from") + 1, F.col("to") - F.col("from")).alias("piece"),
                F.explode(F.sequence(F.greatest(F.col("from") - k, F.lit(0)), F.col("from") + k)).alias("place"))
    )
    # Piece lengths that occur for some left key, so that right keys emit no others.
    lengths = F.broadcast(pieces.select(F.length("piece").alias("n")).distinct())  # one row per length
    b = F.length("right_key")
    grams = (
        right.select("right_key").distinct().filter(b > 0)
        .withColumn("n", F.explode(F.sequence(F.lit(1), b)))
        .join(lengths, "n", "left_semi")
        .withColumn("place", F.explode(F.sequence(F.lit(0), b - F.col("n"))))
        .select("right_key", "place", F.substring("right_key", F.col("place") + 1, F.col("n")).alias("piece"))
    )
    total = F.length("left_key") + F.length("right_key")
    pairs = (
        pieces.join(grams, ["piece", "place"])
        .filter(2 * F.least(F.length("left_key"), F.length("right_key")) >= cutoff * total - 1e-9)
        .select("left_key", "right_key").distinct()
        .withColumn("ratio", matching_ratio("right_key", "left_key", cutoff))
        .filter(F.col("ratio") >= cutoff)
        .groupBy("left_key").agg(F.max(F.struct("ratio", "right_key")).alias("b"))
        .select("left_key", "b.right_key", "b.ratio")
    )
    return pairs.join(right, "right_key").select("left_key", "right_key", "ratio", *extra)


# -- canonical roll-up --------------------------------------------------------
def slug_title(slug: Column | str) -> Column:
    parts = F.split(col(slug), "-")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def canonical_mentions(matched: DataFrame, index: DataFrame, name: str = NAME) -> DataFrame:
    """Mentions per catalogue song, unmentioned songs included.

    The most mentioned spelling names the song; among equals the smallest. A song never
    mentioned is named after its slug.
    """
    counted = (
        matched.filter("slug is not null")
        .groupBy("slug")
        .agg(F.sum(MENTIONS).alias("total"),
             F.min_by(name, F.struct(-F.col(MENTIONS), F.col(name))).alias("best"),
             F.max(MENTIONS).alias("most"))
    )
    return (
        index.select("slug").distinct().join(counted, "slug", "left")
        .select("slug",
                F.when(F.col("most") > 0, F.col("best")).otherwise(slug_title("slug")).alias(NAME),
                F.coalesce("total", F.lit(0)).alias(MENTIONS))
    )


def match_coverage(songs: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Songs matched and unmatched per source; ``songs`` has one nullable column a source."""
    n = F.count(F.lit(1))
    cols = [n.alias("corpus_songs")]
    for s in sources:
        cols += [F.count(s).alias(f"matched_{s}"), (n - F.count(s)).alias(f"unmatched_{s}")]
    return songs.agg(*cols)


def misses_per_source(misses: DataFrame, sample: int = 5) -> DataFrame:
    """Misses per source with the first names as a sample. Columns: source, song."""
    first = top_per_key(misses, ["source"], ["song"], sample)
    names = first.groupBy("source").agg(F.array_sort(F.collect_list("song")).alias("sample"))
    return misses.groupBy("source").agg(F.count(F.lit(1)).alias("misses")).join(names, "source")


def next_songs(corpus: DataFrame, done: DataFrame, sources: Sequence[str], n: int) -> DataFrame:
    """The most mentioned songs with a source still to look up. A recorded miss is done.

    ``done``: name, source.
    """
    wanted = done.filter(F.col("source").isin(*sources)).groupBy(NAME).agg(F.count_distinct("source").alias("n_done"))
    return (
        corpus.join(wanted, NAME, "left")
        .filter(F.coalesce("n_done", F.lit(0)) < len(set(sources)))
        .drop("n_done").orderBy(F.desc(MENTIONS), F.lower(NAME), NAME).limit(n)
    )


# -- posts --------------------------------------------------------------------
def posts_for_songs(songs: DataFrame, posts: DataFrame, post_order: Sequence[str], k: int = fixed.POSTS_PER_SONG,
                    decode=unescape) -> DataFrame:
    """First ``k`` posts whose title holds the song name as whole words.

    Titles explode into word runs no longer than the longest song key and meet the keys
    by an equi join. ``songs``: song_name; ``posts``: title, text, url, created and order.
    """
    title = song_key("title", decode)
    for word in fixed.DISCUSSION_WORDS:
        title = F.replace(title, F.lit(word), F.lit(" "))
    keyed = songs.select("song_name", song_key("song_name", decode).alias("key")).filter(
        F.length("key") >= fixed.MIN_MENTION_KEY).withColumn("n_words", F.size(F.split("key", " ")))
    sizes = F.broadcast(keyed.select("n_words").distinct())  # one row per number of words
    runs = (
        posts.withColumn("w", words(title))
        .withColumn("n_words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))))
        .join(sizes, "n_words", "left_semi")
        .filter(F.size("w") >= F.col("n_words"))
        .withColumn("key", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size("w") - F.col("n_words") + 1),
            lambda i: F.array_join(F.slice("w", i, F.col("n_words")), " ")))))
        .drop("w")
    )
    text = F.when(F.coalesce(F.col("text"), F.lit("")) != "",
                  F.concat("title", F.lit(" -- "), cap("text", fixed.POST_TEXT_CAP))).otherwise(F.col("title"))
    hits = runs.join(keyed, ["key", "n_words"])
    return top_per_key(hits, ["song_name"], post_order, k).select(
        "song_name", "rank", F.lit(fixed.SOURCE_FORUM).alias("source"), collapse(text).alias("text"), "url",
        F.col("created").alias("date"))


# -- merged entries -----------------------------------------------------------
def merge_song_entries(parsed: DataFrame, song: str = "song", priority: str = "priority") -> dict[str, DataFrame]:
    """Entries of one song from several sources as four tables.

    ``songs``            title and first-played hint of the first source that has them, longest
                         lyrics (ties: first source)
    ``credits``, ``links``, ``interpretations``
                         distinct values with ``first_at``, the place of their first appearance

    The lists stay rows: a song everybody writes about never has to fit into one value.
    A page shared by songs (its link has a fragment) gives its link and no text.
    """
    shared = F.contains("url", F.lit("#"))
    rows = parsed.withColumn("_shared", F.coalesce(shared, F.lit(False)))
    own = rows.filter(~F.col("_shared"))
    text = F.when(~F.col("_shared") & (F.coalesce("lyrics_text", F.lit("")) != ""), F.col("lyrics_text"))
    hint = F.when(~F.col("_shared"), F.nullif("first_played_hint", F.lit("")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(priority)))
    songs = rows.groupBy(song).agg(
        first(F.nullif("title", F.lit(""))).alias("title"),
        F.max_by(text, F.when(text.isNotNull(), F.struct(F.length(text), -F.col(priority)))).alias("lyrics_text"),
        first(hint).alias("first_played_hint"),
    )

    def distinct_values(df: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
        at = F.struct(F.col(priority), F.col("_no"))
        more = [F.min_by(F.struct(*carry), at).alias("_more")] if carry else []
        out = df.groupBy(song, *keys).agg(F.min(at).alias("first_at"), *more)
        return out.select(song, *keys, "first_at", *(["_more.*"] if carry else []))

    credits = None
    for kind, field in (("lyricist", "lyricists"), ("music", "music_by")):
        part = own.select(song, priority, F.posexplode(field).alias("_no", "credit")).filter(
            F.col("credit") != "").withColumn("kind", F.lit(kind))
        credits = part if credits is None else credits.unionByName(part)
    links = rows.filter("url is not null").select(song, priority, F.lit(0).alias("_no"), "url")
    notes = own.select(song, priority, F.posexplode("interpretations").alias("_no", "i")).select(
        song, priority, "_no", "i.source", "i.text", F.col("i.url").alias("interpretation_url"),
        F.col("i.date").alias("date"))
    return {
        "songs": songs,
        "credits": distinct_values(credits, ["kind", "credit"]),
        "links": distinct_values(links, ["url"]),
        "interpretations": distinct_values(notes, ["source", "text"], ["interpretation_url", "date"]),
    }


def pending_sources(songs: DataFrame, interpretations: DataFrame, forum_blocked: bool = False, song: str = "song") -> DataFrame:
    """Sources still expected per song: one row per hook, in name order when sorted."""
    have = interpretations.filter(F.col("source") == fixed.SOURCE_FIELDS).select(song)
    waiting = songs.select(song).join(have, song, "left_anti").withColumn("hook", F.lit(fixed.HOOK_FIELDS))
    if forum_blocked:
        waiting = waiting.unionByName(songs.select(song).withColumn("hook", F.lit(fixed.HOOK_FORUM)))
    return waiting.distinct()
