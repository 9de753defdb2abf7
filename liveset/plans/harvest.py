"""From landed item documents to conformed show tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveset.operators.durations import match_durations, set_tracks
from liveset.operators.merge import SHOW, normalize_reviews
from liveset.operators.setlists import POSITION, extract_setlists


def conform_items(items: DataFrame) -> dict[str, DataFrame]:
    """Reviews, shows, songs with durations, transitions, guests and tracks of items."""
    described = items.withColumn("description", F.coalesce("metadata.description", F.lit("")))
    tables = extract_setlists(described)
    tracks = set_tracks(items)
    matched = match_durations(tables["songs"], tracks, POSITION)
    shows = items.select(
        SHOW, *[F.coalesce(F.col(f"metadata.{c}"), F.lit("")).alias(c) for c in ("venue", "date", "creator")],
        F.coalesce(F.trim("metadata.description"), F.lit("")).alias("raw_description"))
    songs = tables["songs"].join(
        matched.select(SHOW, "song_name", F.col("length").alias("duration"), "track_file"), [SHOW, "song_name"], "left")
    return {**tables, "reviews": normalize_reviews(items), "shows": shows, "songs": songs, "tracks": tracks}
