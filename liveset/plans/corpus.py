"""Assembling the typed text corpus from the conformed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.text import blank_to_null, has_text, strip
from liveset.operators.chunks import chunk_words
from liveset.scale import first_row_per_key

SHOW = "show_identifier"
COLUMNS = {
    "type": "string", "text": "string", "comment_text": "string", SHOW: "string", "created": "string", "rating": "string",
    "reviewer": "string", "song_name": "string", "duration": "string", "duration_seconds": "double", "track_file": "string",
    "guest_artist": "string", "transition_from": "string", "transition_to": "string", "source": "string", "title": "string",
    "url": "string", "chunk_index": "int", "word_count": "int", "source_urls": "array<string>", "lyricists": "array<string>",
    "music_by": "array<string>", "interpretation_source": "string", "interpretation_url": "string",
}


def _row(df: DataFrame, type_: str, **cols: Column) -> DataFrame:
    """``df`` as corpus rows of one type.

    ``row_id`` is a digest of what the row says: the same in every run and on every
    partitioning, and wide enough for trillions of rows. Identical rows share it.
    ``position`` is the row's place in its file, where ``df`` has one; it is no part of the id.
    """
    named = {"type": F.lit(type_), **cols}
    position = F.col("position") if "position" in df.columns else F.lit(None)
    out = df.select(*[
        (named[c] if c in named else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()], position.cast("long").alias("position"))
    return out.select(F.md5(F.to_json(F.struct(*COLUMNS))).alias("row_id"), *COLUMNS, "position")


def _with_position(df: DataFrame, *columns: str) -> list[str]:
    return [*columns, *[c for c in ("position",) if c in df.columns]]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def comment_rows(comments: DataFrame) -> DataFrame:
    text = strip("comment_text")
    return _row(comments.filter(has_text("comment_text")), "comment", text=text, comment_text=text,
                show_identifier=_text(SHOW), created=_text("created"), rating=F.col("rating"),
                reviewer=F.coalesce(blank_to_null("reviewer"), F.lit(fixed.ANONYMOUS)))


def setlist_song_rows(songs: DataFrame, order: list[str], artist: str = fixed.ARTIST) -> DataFrame:
    """Distinct songs of a show, first mention first. Set songs come before flat ones by
    their ``order`` columns. Optional columns: date, duration."""
    named = songs.withColumn("song_name", strip("song_name")).filter(F.col("song_name") != "")
    unique = first_row_per_key(named, [SHOW, "song_name"], order)
    name = F.col("song_name")
    return _row(unique, "setlist_song", text=F.concat(name, F.lit(f" - {artist} setlist")),
                comment_text=F.concat(F.lit("[Setlist] "), name, F.lit(" performed at "), SHOW),
                show_identifier=F.col(SHOW), song_name=name,
                created=_text("date") if "date" in songs.columns else F.lit(""),
                duration=blank_to_null("duration") if "duration" in songs.columns else F.lit(None))


def guest_rows(guests: DataFrame, artist: str = fixed.ARTIST) -> DataFrame:
    g = F.col("guest_artist")
    return _row(guests.filter(_text("guest_artist") != ""), "guest_artist",
                text=F.concat(g, F.lit(f" played with {artist} at "), SHOW),
                comment_text=F.concat(F.lit("[Guest] "), g, F.lit(f" performed with {artist}")),
                show_identifier=F.col(SHOW), guest_artist=g,
                created=_text("date") if "date" in guests.columns else F.lit(""))


def transition_rows(transitions: DataFrame) -> DataFrame:
    both = (_text("transition_from") != "") & (_text("transition_to") != "")
    pair = F.concat("transition_from", F.lit(" -> "), "transition_to")
    return _row(transitions.filter(both), "transition", text=F.concat(F.lit("Transition: "), pair),
                comment_text=F.concat(F.lit("[Transition] "), pair), show_identifier=F.col(SHOW),
                transition_from=F.col("transition_from"), transition_to=F.col("transition_to"),
                created=_text("date") if "date" in transitions.columns else F.lit(""))


def transcript_rows(transcripts: DataFrame, size: int = fixed.CHUNK_WORDS) -> DataFrame:
    chunks = chunk_words(transcripts.filter(has_text("transcript")).select(*_with_position(transcripts, "title", "url", "transcript")), "transcript", size)
    title = _text("title")
    return _row(chunks, "deadcast_transcript", text=F.col("chunk"),
                comment_text=F.concat(F.lit("[Deadcast] "), title, F.lit(" (chunk "), F.col("chunk_index").cast("string"), F.lit(")")),
                show_identifier=F.lit(""), source=F.lit("deadcast"), title=title, url=_text("url"),
                chunk_index=F.col("chunk_index"), word_count=F.col("word_count"))


def duration_rows(durations: DataFrame, artist: str = fixed.ARTIST) -> DataFrame:
    shown = _text("duration_display")
    return _row(durations, "ep_duration",
                text=F.concat("song", F.lit(f" by {artist} - "), shown, F.lit(" at "), SHOW),
                comment_text=F.concat(F.lit("[EP Duration] "), F.col("song"), F.lit(": "), shown, F.lit(" ("),
                                      F.coalesce(F.col("duration_seconds").cast("string"), F.lit("0")), F.lit("s) at "), F.col(SHOW)),
                show_identifier=F.col(SHOW), song_name=F.col("song"), duration=shown,
                duration_seconds=F.col("duration_seconds"), track_file=_text("track_file"),
                source=F.coalesce("source", F.lit("positional")))


def lyric_rows(lyrics: DataFrame) -> DataFrame:
    text = strip("lyrics_text")
    return _row(lyrics.filter(has_text("lyrics_text")), "lyric", text=text, comment_text=text, title=F.col("title"),
                song_name=F.col("title"), source_urls=F.col("source_urls"), lyricists=F.col("lyricists"), music_by=F.col("music_by"))


def interpretation_rows(lyrics: DataFrame) -> DataFrame:
    each = lyrics.select(*_with_position(lyrics, "title", "source_urls", "lyricists", "music_by"), F.explode("interpretations").alias("i")).select(
        "*", "i.source", "i.text", "i.url")
    text = strip("text")
    return _row(each.filter(has_text("text")), "interpretation", text=text, comment_text=text, title=F.col("title"),
                song_name=F.col("title"), source_urls=F.col("source_urls"), lyricists=F.col("lyricists"),
                music_by=F.col("music_by"), interpretation_source=_text("source"), interpretation_url=_text("url"))


def rich_tables(rich: DataFrame) -> dict[str, DataFrame]:
    """Songs, guests and transitions of rich set lists as flat tables.

    Songs of the sets come first, then those of the flat list; a flat entry may be an
    object, of which the name counts.
    """
    in_sets = (
        rich.select(SHOW, "date", F.posexplode("sets").alias("set_order", "s"))
        .select(SHOW, "date", "set_order", F.posexplode("s.songs").alias("song_no", "g"))
        .select(SHOW, "date", F.lit(0).alias("part"), "set_order", "song_no", F.col("g.name").alias("song_name"), "g.duration")
    )
    name = F.when(F.col("g").startswith("{"), F.get_json_object("g", "$.name")).otherwise(F.col("g"))
    flat = rich.select(SHOW, "date", F.posexplode("songs").alias("song_no", "g")).select(
        SHOW, "date", F.lit(1).alias("part"), F.lit(0).alias("set_order"), "song_no", name.alias("song_name"),
        F.lit(None).cast("string").alias("duration"))
    pairs = rich.select(SHOW, "date", F.explode("transitions").alias("t")).select(
        SHOW, "date", F.col("t.from").alias("transition_from"), F.col("t.to").alias("transition_to"))
    return {
        "songs": in_sets.unionByName(flat),
        "guests": rich.select(SHOW, "date", F.explode("guest_artists").alias("guest_artist")),
        "transitions": pairs,
    }


def assemble_corpus(*parts: DataFrame) -> DataFrame:
    """All given row sets under one schema. Nothing is dropped, so counts add up. ``section``
    numbers the sets in the order given: corpus order is by section, position and chunk."""
    numbered = [p.withColumn("section", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
