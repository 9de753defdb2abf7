"""Result rows as text: one line or card per hit, contexts and extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liveset.functions.text import blank_to_null, cap, ellipsis, show_url
from liveset.operators.merge import top_per_key


def _c(df: DataFrame, name: str) -> Column:
    """Column as text, empty where it is missing or null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _or(c: Column, fallback: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(fallback))


def result_line(df: DataFrame, rank: str = "rank") -> Column:
    """Numbered result, laid out by row type; texts beyond 500 characters end in dots."""
    n, show = F.col(rank).cast("string"), _c(df, "show_identifier")
    url = show_url(show)
    link = F.when(url != "", F.concat(F.lit("("), url, F.lit(")"))).otherwise("")
    text, created = ellipsis(_c(df, "comment_text"), 500), _c(df, "created")
    duration = _c(df, "duration")
    head = F.concat(F.lit("["), n, F.lit("] Show: "), show, F.lit(" "), link, F.lit(" "))
    with_duration = F.when(duration != "", F.concat(F.lit(" (duration: "), duration, F.lit(")"))).otherwise("")
    venue = F.when(_c(df, "venue") != "", F.concat(F.lit(" | Venue: "), _c(df, "venue"))).otherwise("")
    clock = F.coalesce(blank_to_null(_c(df, "duration_formatted")), duration)
    kind = F.coalesce(blank_to_null(F.col("type")), F.lit("comment"))
    return (
        F.when(kind == "comment", F.concat(
            head, F.lit("(rating: "), _or(_c(df, "rating"), "N/A"), F.lit("/5, date: "), created, F.lit(")\nComment: "), text))
        .when(kind == "setlist_song", F.concat(
            head, F.lit("(song: "), _c(df, "song_name"), with_duration, F.lit(", date: "), created, F.lit(")\nSetlist entry: "), text))
        .when(kind == "guest_artist", F.concat(
            head, F.lit("(guest: "), _c(df, "guest_artist"), F.lit(", date: "), created, F.lit(")\n"), text))
        .when(kind == "transition", F.concat(
            head, F.lit("(transition: "), _c(df, "transition_from"), F.lit(" -> "), _c(df, "transition_to"),
            F.lit(", date: "), created, F.lit(")\n"), text))
        .when(kind == "deadcast_transcript", F.concat(
            F.lit("["), n, F.lit("] Deadcast: "), _c(df, "title"), F.lit(" ("), _or(_c(df, "word_count"), "0"),
            F.lit(" words)\nURL: "), _c(df, "url"), F.lit("\nContext: "),
            F.coalesce(blank_to_null(_c(df, "context")), text)))
        .when(kind == "ep_duration", F.concat(
            F.lit("["), n, F.lit("] EP Duration: "), clock, F.lit(" ("), _or(_c(df, "duration_seconds"), "0"), F.lit("s)\nShow: "),
            show, F.lit(" ("), url, F.lit(")\nTrack: "), _c(df, "track_file"), venue, F.lit("\nDate: "), _or(created, "unknown")))
        .otherwise(F.concat(F.lit("["), n, F.lit("] "), text))
    )


def format_result(hits: DataFrame, rank: str = "rank") -> DataFrame:
    return hits.withColumn("line", result_line(hits, rank))


def chat_line(df: DataFrame, rank: str = "rank") -> Column:
    """Short chat entry: label, link, 350 characters on one line."""
    show = _c(df, "show_identifier")
    link = F.when(show != "", F.concat(F.lit(" <"), show_url(show), F.lit(">"))).otherwise("")
    text = F.replace(cap(_c(df, "comment_text"), 350), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("**"), F.col(rank).cast("string"), F.lit(". "), source_label(df), F.lit("**"), link, F.lit("\n"), text)


def message_line(df: DataFrame, rank: str = "rank") -> Column:
    """Messenger entry: linked show, rating and date, 400 characters."""
    show = _or(_c(df, "show_identifier"), "?")
    return F.concat(
        F.lit("*"), F.col(rank).cast("string"), F.lit("* ["), show, F.lit("]("), show_url(_c(df, "show_identifier")),
        F.lit(")\nRating: "), _or(_c(df, "rating"), "N/A"), F.lit("/5 | Date: "), _or(_c(df, "created"), "N/A"),
        F.lit("\n"), cap(_c(df, "comment_text"), 400), F.lit("\n"))


def tool_line(df: DataFrame, rank: str = "rank") -> Column:
    """Tool entry: score to three places and 500 characters."""
    show = _c(df, "show_identifier")
    return F.concat(
        F.lit("**#"), F.col(rank).cast("string"), F.lit("** ["), show, F.lit("]("), show_url(show), F.lit(") — Score: "),
        F.format_string("%.3f", F.col("score")), F.lit("\nRating: "), _c(df, "rating"), F.lit(" | Date: "), _c(df, "created"),
        F.lit("\n_"), cap(_c(df, "comment_text"), 500), F.lit("..._\n"))


def digest_line(df: DataFrame, rank: str = "rank") -> Column:
    """Digest entry: rating, date and 400 characters, dots where cut."""
    show = _c(df, "show_identifier")
    return F.concat(
        F.lit("**#"), F.col(rank).cast("string"), F.lit("** · ["), show, F.lit("]("), show_url(show), F.lit(")\nRating: "),
        _c(df, "rating"), F.lit("/5 · "), _c(df, "created"), F.lit("\n"), ellipsis(_c(df, "comment_text"), 400), F.lit("\n"))


def answer_line(df: DataFrame, rank: str = "rank") -> Column:
    """Entry of an extractive answer: 300 characters, dots where cut."""
    show = _or(_c(df, "show_identifier"), "N/A")
    return F.concat(
        F.lit("**#"), F.col(rank).cast("string"), F.lit("** — ["), show, F.lit("]("), show_url(_c(df, "show_identifier")),
        F.lit(")\nRating: "), _or(_c(df, "rating"), "N/A"), F.lit("/5 | Date: "), _or(_c(df, "created"), "N/A"),
        F.lit("\n_"), ellipsis(_c(df, "comment_text"), 300), F.lit("_\n"))


def lyric_card(df: DataFrame) -> Column:
    """Lyrics with credits and source links."""
    joined = lambda c: _or(F.array_join(c, ", "), "n/a")
    links = F.when(F.size("source_urls") > 0, F.array_join(F.transform("source_urls", lambda u: F.concat(F.lit("  • "), u)), "\n")
                   ).otherwise("  (no source URLs)")
    name = F.coalesce(blank_to_null("song_name"), blank_to_null(_c(df, "title")), F.lit("?"))
    return F.concat(F.lit("Song: "), name, F.lit("\nLyricists: "), joined("lyricists"), F.lit(" | Music: "), joined("music_by"),
                    F.lit("\nSources:\n"), links, F.lit("\n\n"), _c(df, "comment_text"))


def note_line(df: DataFrame, rank: str = "rank") -> Column:
    """Interpretation entry: source, link, 800 characters."""
    url = _c(df, "interpretation_url")
    head = F.concat(F.col(rank).cast("string"), F.lit(". "), _c(df, "interpretation_source"),
                    F.when(url != "", F.concat(F.lit(" — "), url)).otherwise(""))
    return F.concat(F.lit("\n"), head, F.lit("\n"), cap(_c(df, "comment_text"), 800))


def source_label(df: DataFrame) -> Column:
    book = F.concat(F.lit("book: "), F.coalesce(
        blank_to_null(_c(df, "book_title")), blank_to_null(_c(df, "title")), F.lit("?")))
    kind = F.coalesce(blank_to_null(F.col("type")), F.lit("comment"))
    return F.when(kind == "book_chunk", book).otherwise(F.coalesce(
        blank_to_null(_c(df, "show_identifier")), blank_to_null(_c(df, "song_name")), kind))


def context_line(df: DataFrame, rank: str = "rank", max_chars: int = 600) -> Column:
    """Source passage of a hit: label, link, rating, date, then its text."""
    show, rating, created = (_c(df, c) for c in ("show_identifier", "rating", "created"))
    if "rating" in df.columns and isinstance(df.schema["rating"].dataType, T.NumericType):
        rating = F.when(F.col("rating") == 0, "").otherwise(rating)  # a number of 0 is no rating
    part = lambda c, before, after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    return F.concat(
        F.lit("["), F.col(rank).cast("string"), F.lit("] "), source_label(df), part(show_url(show), " — "),
        part(rating, " (rating ", "/5)"), part(created, " posted "), F.lit("\n"), cap(_c(df, "comment_text"), max_chars))


def context_lines(hits: DataFrame, rank: str = "rank", max_chars: int = 600) -> DataFrame:
    return hits.withColumn("line", context_line(hits, rank, max_chars))


def join_lines(lines: DataFrame, separator: str = "\n\n", rank: str = "rank", k: int | None = None) -> DataFrame:
    """The lines of each question, by rank, as one text; equal ranks go by line.

    Callers give the ``k`` of their search: lines are then cut to the first ``k`` before
    they are gathered, whatever the ranks. Without it every line given is in the text.
    """
    lines = lines.select("question_id", rank, "line")
    if k is not None:
        lines = top_per_key(lines, ["question_id"], [rank, "line"], k, "_place")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col("line"))))
    return lines.groupBy("question_id").agg(ordered.alias("_l")).select(
        "question_id", F.array_join(F.transform("_l", lambda x: x["line"]), separator).alias("text"),
        F.size("_l").alias("n_sources"))


def build_context(hits: DataFrame, max_chars: int = 600, **kw) -> DataFrame:
    return join_lines(context_lines(hits, max_chars=max_chars), **kw)


def extractive_answer(hits: DataFrame, **kw) -> DataFrame:
    """Answer made of the hits themselves, under a line saying how many there are."""
    joined = join_lines(hits.withColumn("line", answer_line(hits)), separator="\n", **kw)
    return joined.withColumn("text", F.concat(
        F.format_string("Based on %d sources:\n\n", F.col("n_sources")), F.col("text")))


def _song_name(df: DataFrame) -> Column:
    return F.coalesce(blank_to_null(_c(df, "song_name")), blank_to_null(_c(df, "title")), F.lit("?"))


def song_texts(questions: DataFrame, hits: DataFrame, k: int, question: str = "question", rank: str = "rank") -> DataFrame:
    """Two texts a question from its lyric search: ``lyrics``, the best lyric row as a card, and
    ``meaning``, that row without its credits and all interpretations found, in order.

    ``questions``: question_id and the question; ``hits``: the first ``k`` rows of each with
    their columns. A question without rows of a kind gets the line that says so.
    """
    hits = hits.filter(F.col(rank) <= k)  # also bounds what is gathered below
    lyric = hits.filter(F.col("type") == "lyric")
    links = F.when(F.size("source_urls") > 0, F.array_join(F.transform("source_urls", lambda u: F.concat(F.lit("  • "), u)), "\n")
                   ).otherwise("  (no source URLs)")
    plain = F.concat(F.lit("Song: "), _song_name(lyric), F.lit("\nSources:\n"), links, F.lit("\n\n"), _c(lyric, "comment_text"))
    first = lyric.groupBy("question_id").agg(
        F.min_by(lyric_card(lyric), rank).alias("_card"), F.min_by(plain, rank).alias("_plain"))
    notes = hits.filter(F.col("type") == "interpretation")
    notes = top_per_key(notes, ["question_id"], [rank], k, "_no")
    notes = join_lines(notes.withColumn("line", note_line(notes, "_no")), "\n", "_no", k).select("question_id", F.col("text").alias("_notes"))
    found = questions.select("question_id", F.col(question).alias("_q")).join(first, "question_id", "left").join(notes, "question_id", "left")
    none, quoted = F.col("_card").isNull(), F.concat(F.lit('"'), F.col("_q"), F.lit('"'))
    lyrics = F.when(none, F.concat(F.lit("No lyrics found matching "), quoted, F.lit('. Try meaning "song name".'))).otherwise(F.concat(
        F.lit("LYRICS — "), F.col("_q"), F.lit("\n\n"), F.col("_card"), F.lit('\n\n\nTip: use meaning "song name" for lyrics + interpretations.')))
    meaning = F.when(none & F.col("_notes").isNull(), F.concat(F.lit("No lyrics or interpretations found matching "), quoted, F.lit("."))).otherwise(F.concat(
        F.lit("MEANING — "), F.col("_q"), F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), F.col("_plain")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n\n\nINTERPRETATIONS\n"), F.col("_notes")), F.lit(""))))
    return found.select("question_id", lyrics.alias("lyrics"), meaning.alias("meaning"))
