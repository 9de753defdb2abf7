"""Track durations: audio files, best take per track, matching songs to tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.dates import show_date_key
from liveset.functions.text import (
    blank_to_null, clean_track_title, disc_track, duration_display, duration_seconds, is_non_song, strip, track_number,
)
from liveset.scale import HOT_ROWS, checkpoint, hot_buckets, row_ordinal

SHOW = "show_identifier"


def audio_files(items: DataFrame, formats: Sequence[str] = fixed.AUDIO_FORMATS) -> DataFrame:
    """One row per audio file of an item, in file order."""
    name = F.coalesce(F.col("f.name"), F.lit(""))
    suffixes = [~name.endswith(s) for s in fixed.NON_AUDIO_SUFFIXES]
    keep = F.col("f.format").isin(*formats) & ~F.contains(name, F.lit("archive.torrent"))
    for s in suffixes:
        keep &= s
    return (
        items.select(SHOW, F.posexplode("files").alias("file_no", "f"))
        .filter(keep)
        .select(SHOW, "file_no", name.alias("name"), F.coalesce(F.col("f.title"), F.lit("")).alias("title"),
                F.col("f.length").alias("length"), F.col("f.format").alias("format"))
    )


def set_tracks(items: DataFrame) -> DataFrame:
    """Tracks of a show keyed by file stem; the last file of a stem gives its values,
    the first one its place."""
    stem = F.col("name")
    for suffix in (".flac", ".mp3", ".ogg"):
        stem = F.replace(stem, F.lit(suffix), F.lit(""))
    return (
        audio_files(items, fixed.TRACK_FORMATS)
        .filter((F.col("name") != "") & (F.coalesce(F.col("length"), F.lit("")) != ""))
        .withColumn("track_file", stem)
        .groupBy(SHOW, "track_file")
        .agg(
            F.min("file_no").alias("file_no"),
            F.max_by(F.struct("length", "format", "title"), "file_no").alias("last"),
        )
        .select(SHOW, "track_file", "file_no", "last.*", track_number("track_file").alias("track_no"))
    )


def track_best(files: DataFrame, **kw) -> DataFrame:
    """Longest take per (show, disc, track), numbered across the discs of a show.

    The first file by name wins unless another is strictly longer; unknown durations
    lose. Input columns: show_identifier, name, length.
    """
    kw.setdefault("hot", hot_buckets(files, [SHOW], kw.get("hot_rows", HOT_ROWS)))
    best = (
        files.select(SHOW, disc_track("name").alias("p"), "name", "length", duration_seconds("length").alias("duration_seconds"))
        .select(SHOW, F.col("p.disc").alias("disc"), F.col("p.track").alias("track_in_disc"), "name", "length", "duration_seconds")
        .groupBy(SHOW, "disc", "track_in_disc")
        .agg(
            F.min_by(
                F.struct("duration_seconds", F.col("length").alias("duration_display"), F.col("name").alias("file_name")),
                F.struct(F.coalesce(-F.col("duration_seconds"), F.lit(float("inf"))), F.col("name")),
            ).alias("b")
        )
        .select(SHOW, "disc", "track_in_disc", "b.*")
    )
    return row_ordinal(best, [SHOW], ["disc", "track_in_disc"], "track_no", **kw)


# -- songs to tracks ----------------------------------------------------------
def match_tracks_by_title(songs: DataFrame, tracks: DataFrame, song_order: Sequence[str],
                          track_order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Songs whose name equals a track title, and the tracks so used.

    Titles of non-songs never match. Of several tracks with one title the last counts;
    of several spellings of one song the first.
    """
    title = strip(F.replace(F.replace(F.col("title"), F.lit("->"), F.lit("")), F.lit("&gt;"), F.lit("")))
    named = (
        tracks.withColumn("match_key", F.lower(title))
        .filter((strip("title") != "") & ~is_non_song("match_key", fixed.NON_SONG_PHRASES))
    )
    spelling = songs.groupBy(SHOW, F.lower("song_name").alias("match_key")).agg(
        F.min_by("song_name", F.struct(*song_order)).alias("song_name")
    )
    info = [c for c in ("length", "track_file") if c in tracks.columns]
    latest = named.groupBy(SHOW, "match_key").agg(
        F.max_by(F.struct(*info, *track_order), F.struct(*track_order)).alias("t")
    )
    matched = spelling.join(latest, [SHOW, "match_key"]).select(
        SHOW, "song_name", *[F.col(f"t.{c}").alias(c) for c in info], F.lit("title").alias("match_source")
    )
    used = named.join(spelling, [SHOW, "match_key"], "left_semi").drop("match_key")
    return matched, used


def match_tracks_by_position(songs: DataFrame, tracks: DataFrame, song_order: Sequence[str],
                             track_order: Sequence[str], out: Sequence[str] = ("length", "track_file"),
                             **kw) -> DataFrame:
    """The k-th song of a show with the k-th track. A repeated name keeps its last match."""
    left = row_ordinal(songs, [SHOW], song_order, "k", **kw)
    right = row_ordinal(tracks, [SHOW], track_order, "k", **kw).select(SHOW, "k", *out)
    return (
        left.join(right, [SHOW, "k"])
        .groupBy(SHOW, "song_name").agg(F.max_by(F.struct(*out), "k").alias("t"))
        .select(SHOW, "song_name", *[F.col(f"t.{c}").alias(c) for c in out], F.lit("position").alias("match_source"))
    )


def match_durations(songs: DataFrame, tracks: DataFrame, song_order: Sequence[str],
                    track_order: Sequence[str] = ("track_no", "file_no"), **kw) -> DataFrame:
    """Duration of every song of a show: by title first, leftovers by position."""
    matched, used = match_tracks_by_title(songs, tracks, song_order, track_order)
    rest_songs = songs.join(matched, [SHOW, "song_name"], "left_anti")
    rest_tracks = tracks.join(used, [SHOW, "track_file"], "left_anti")
    return matched.unionByName(match_tracks_by_position(rest_songs, rest_tracks, song_order, track_order, **kw))


# -- one song across shows ----------------------------------------------------
def _known(seconds: str | Column) -> Column:
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.coalesce(seconds, F.lit(0.0)) != 0


_FOUND = ["duration_seconds", "duration_display", "track_file", "source"]


def by_file_title(files: DataFrame, song: str) -> DataFrame:
    """First file whose title equals or holds the song name; no usable duration, no row."""
    hit = (
        files.filter(strip("title") != "")
        .filter(F.contains(clean_track_title("title"), F.lit(song.lower())))
        .groupBy(SHOW)
        .agg(F.min_by(F.struct("length", "name"), "file_no").alias("f"))
    )
    return (
        hit.select(SHOW, duration_seconds("f.length").alias("duration_seconds"),
                   F.col("f.length").alias("duration_display"), F.col("f.name").alias("track_file"),
                   F.lit(fixed.BY_TITLE).alias("source"))
        .filter(_known("duration_seconds"))
    )


def match_track_table(listing: DataFrame, best: DataFrame, song: str, **kw) -> DataFrame:
    """External track listing against audio files: by track number, then by position.

    ``listing``: show_identifier, listing_no (order), track_number, title.
    """
    name = song.lower()
    wanted = F.lower("title") == name
    found = lambda source: [
        "duration_seconds", "duration_display", F.col("file_name").alias("track_file"), F.lit(source).alias("source")]
    usable = best.filter(_known("duration_seconds"))
    direct = (
        listing.filter(wanted)
        .join(usable.withColumnRenamed("track_no", "track_number"), [SHOW, "track_number"])
        .groupBy(SHOW).agg(F.min_by(F.struct(*found(fixed.BY_LISTING_NUMBER)), "listing_no").alias("m"))
        .select(SHOW, "m.*", F.lit(1).alias("priority"))
    )
    numbered = row_ordinal(listing.filter(~is_non_song("title")), [SHOW], ["track_number"], "track_no", **kw)
    positional = (
        numbered.filter(wanted).select(SHOW, "track_no")
        .join(usable, [SHOW, "track_no"])
        .groupBy(SHOW).agg(F.min_by(F.struct(*found(fixed.BY_LISTING_PLACE)), "track_no").alias("m"))
        .select(SHOW, "m.*", F.lit(2).alias("priority"))
    )
    return _by_priority(direct.unionByName(positional))


def by_position(songs: DataFrame, best: DataFrame, song: str, song_order: Sequence[str] = ("line_no", "item_no"),
                **kw) -> DataFrame:
    """Place of the song in the set order against the place of the track.

    When that track has no duration and there are more tracks than songs, tracks under
    two minutes are left out and the place is read again.
    """
    numbered = row_ordinal(songs, [SHOW], list(song_order), "k", **kw)
    place = numbered.groupBy(SHOW).agg(
        F.min(F.when(F.lower("song_name") == song.lower(), F.col("k"))).alias("k"),
        F.count(F.lit(1)).alias("n_songs"),
    ).filter("k is not null")
    n_tracks = best.groupBy(SHOW).agg(F.count(F.lit(1)).alias("n_tracks"))
    found = lambda source: [
        SHOW, "duration_seconds", "duration_display", F.col("file_name").alias("track_file"), F.lit(source).alias("source")]
    plain = (
        place.join(best.withColumnRenamed("track_no", "k"), [SHOW, "k"])
        .filter(_known("duration_seconds")).select(*found(fixed.BY_PLACE), F.lit(1).alias("priority"))
    )
    long_tracks = row_ordinal(best.filter(F.col("duration_seconds") >= fixed.POSITIONAL_MIN_SECONDS).drop("track_no"),
                              [SHOW], ["disc", "track_in_disc"], "k", **kw)
    filtered = (
        place.join(n_tracks, SHOW).filter("n_tracks > n_songs")
        .join(long_tracks, [SHOW, "k"])
        .filter(_known("duration_seconds")).select(*found(fixed.BY_LONG_PLACE), F.lit(2).alias("priority"))
    )
    return _by_priority(plain.unionByName(filtered))


def _by_priority(df: DataFrame) -> DataFrame:
    return df.groupBy(SHOW).agg(F.min_by(F.struct(*_FOUND), "priority").alias("m")).select(SHOW, "m.*")


def song_durations(shows: DataFrame, files: DataFrame, songs: DataFrame, song: str,
                   listing: DataFrame | None = None, **kw) -> DataFrame:
    """Duration of one song in every given show; shows without any match keep nulls.

    Tried in turn: file title, external listing, position.
    """
    # One look at the sizes of shows serves every numbering below.
    kw.setdefault("hot", sorted({*hot_buckets(files, [SHOW]), *hot_buckets(songs, [SHOW])}))
    best = checkpoint(track_best(files, **kw))  # one row a track; used by several steps
    steps = [by_file_title(files, song)]
    if listing is not None:
        steps.append(match_track_table(listing, best, song, **kw))
    steps.append(by_position(songs, best, song, **kw))
    found = None
    for n, step in enumerate(steps):
        step = step.withColumn("priority", F.lit(n))
        found = step if found is None else found.unionByName(step)
    return (
        shows.select(SHOW).distinct().join(_by_priority(found), SHOW, "left").withColumn("song", F.lit(song))
    )


def source_breakdown(durations: DataFrame) -> DataFrame:
    """How many durations came from which kind of match."""
    kind = (
        F.when(F.col("source") == fixed.BY_TITLE, "title")
        .when(F.col("source").isin(fixed.BY_LISTING_NUMBER, fixed.BY_LISTING_PLACE), "external")
        .when(F.col("source").isNotNull(), "positional")
        .otherwise("none")
    )
    return durations.groupBy(kind.alias("match_kind")).agg(F.count(F.lit(1)).alias("n"))


# -- ranking ------------------------------------------------------------------
def top_durations(durations: DataFrame, k: int, song: str | None = None, tie_break: Sequence[str] = (SHOW,)) -> DataFrame:
    """The ``k`` longest performances with their clock display."""
    rows = durations.filter(F.col("duration_seconds").isNotNull())
    if song is not None:
        rows = rows.filter(F.lower("song") == song.lower())
    return (
        rows.orderBy(F.desc("duration_seconds"), *tie_break).limit(k)
        .withColumn("duration_formatted", duration_display("duration_seconds"))
    )


def known_venues(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.KNOWN_VENUES.items()), "show_date string, known_venue string")


def with_venue(durations: DataFrame, venues: DataFrame, undated: str = "") -> DataFrame:
    """Own venue, else the venue known for the date, else unknown; ``undated`` where the
    show key carries no date."""
    keyed = durations.withColumn("show_date", show_date_key(SHOW))
    own = blank_to_null("venue") if "venue" in durations.columns else F.lit(None).cast("string")
    resolved = F.coalesce(
        own, F.when(F.col("show_date").isNull(), F.lit(undated)), F.col("known_venue"), F.lit(fixed.UNKNOWN_VENUE)
    )
    return keyed.join(venues, "show_date", "left").withColumn("venue", resolved).drop("known_venue")
