"""Text columns: whitespace, markup, names, durations, snippets.

Java regexes treat ``\\s``, ``\\w`` and ``\\b`` as ASCII unless ``(?U)`` is set, and
``trim`` removes only spaces; both are handled here once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from liveset import fixed

EMPTY = ""
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it.

    Catalyst inlines aliases and does not share work inside conditions, so a costly text
    expression in many branches would otherwise run once per branch.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def collapse(c: Column | str) -> Column:
    """Runs of whitespace become one space; ends are trimmed. Single spaces are left
    alone by the pattern, which spares most of the matches in ordinary prose."""
    return strip(F.regexp_replace(col(c), r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def words(c: Column | str) -> Column:
    return let(collapse(c), lambda text: F.when(text == EMPTY, F.array().cast("array<string>")).otherwise(F.split(text, " ")))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(EMPTY))


def digits(c: Column, type_: str = "int") -> Column:
    """Number of an extracted run of digits. An empty one skips the cast, because a failing
    ``try_cast`` costs an exception per row."""
    return blank_to_null(c).try_cast(type_)


def first_filled(*cols: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(EMPTY))


def has_text(c: Column | str) -> Column:
    return F.coalesce(strip(c) != EMPTY, F.lit(False))


def alternation(words_: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words_)


def contains_any(c: Column | str, phrases: Sequence[str]) -> Column:
    return let(col(c), lambda text: reduce(or_, [F.contains(text, F.lit(p)) for p in phrases]))


# -- markup -------------------------------------------------------------------
@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(c: Column | str) -> Column:
    """Decode every HTML5 entity. Only texts holding ``&`` travel to Python."""
    c = col(c)
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def unescape_common(c: Column | str) -> Column:
    """Six frequent entities on the JVM, ``&amp;`` last so that nothing decodes twice."""
    c = col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def break_lines(c: Column | str, ignore_case: bool = False) -> Column:
    flag = "(?iU)" if ignore_case else "(?U)"
    return F.regexp_replace(col(c), flag + r"<br\s*/?>", "\n")


def clean_html(c: Column | str) -> Column:
    """Markup removed, line structure kept. Arrays are joined by spaces first."""
    text = F.regexp_replace(break_lines(c), r"<[^>]+>", EMPTY)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.coalesce(strip(F.regexp_replace(text, r"(?U)\n\s*\n+", "\n")), F.lit(EMPTY))


def clean_html_line(c: Column | str, decode: Callable = unescape) -> Column:
    """Visible text on one line: scripts, styles and comments dropped, entities decoded."""
    text = F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.coalesce(collapse(decode(text)), F.lit(EMPTY))


def drop_tags(c: Column | str) -> Column:
    """Tags out; ``<br>`` becomes a newline and a paragraph break a blank line."""
    text = F.regexp_replace(break_lines(c, True), r"(?iU)</p>\s*<p[^>]*>", "\n\n")
    return F.regexp_replace(text, r"<[^>]+>", EMPTY)


def strip_tags(c: Column | str, decode: Callable = unescape) -> Column:
    return decode(drop_tags(c))


# -- reviews ------------------------------------------------------------------
def is_relevant(c: Column | str, keywords: Sequence[str] = fixed.RELEVANT_KEYWORDS) -> Column:
    long_enough = F.length(strip(c)) >= fixed.MIN_RELEVANT_LENGTH
    return F.coalesce(long_enough & contains_any(F.lower(col(c)), keywords), F.lit(False))


# -- song names ---------------------------------------------------------------
def song_key(c: Column | str, decode: Callable | None = unescape) -> Column:
    """Matching key of a song name. The order of the steps is part of the definition."""
    n = decode(col(c)) if decode else col(c)
    n = F.replace(F.lower(n), F.lit("&"), F.lit(" and "))
    return F.trim(_replaced(n, fixed.SONG_KEY_STEPS))


def _replaced(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Patterns replaced one after the other; classes of characters are Unicode's."""
    for pattern, to in steps:
        c = F.regexp_replace(c, f"(?U){pattern}", to or EMPTY)
    return c


def loose_key(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9 ]", EMPTY))


def clean_song_title(c: Column | str, decode: Callable | None = unescape) -> Column:
    """Durations, disc/track codes, bullets, notes and trailing arrows removed."""
    n = decode(col(c)) if decode else col(c)
    n = collapse(_replaced(n, fixed.TITLE_CODES))
    for _ in range(2):
        n = _replaced(n, fixed.TITLE_BULLETS)
    return strip(_replaced(n, fixed.TITLE_ENDS))


def is_song_noise(c: Column | str) -> Column:
    c = col(c)
    return (
        (F.length(c) > fixed.SONG_NAME_LENGTHS[1])
        | c.rlike("(?iU)" + fixed.CREDIT_PATTERN)
        | c.rlike("(?iU)" + fixed.NOISE_PATTERN)
    )


def is_song_length(c: Column | str) -> Column:
    return F.length(col(c)).between(*fixed.SONG_NAME_LENGTHS)


def clean_track_title(c: Column | str) -> Column:
    """Lower-cased file title without arrows."""
    return strip(F.replace(F.replace(F.lower(col(c)), F.lit("->"), F.lit("")), F.lit(">"), F.lit("")))


def is_non_song(c: Column | str, phrases: Sequence[str] = fixed.NON_SONG_TRACKS) -> Column:
    return contains_any(F.lower(col(c)), phrases)


def disc_track(name: Column | str) -> Column:
    """``struct(disc, track)`` from a file name: ``d2t03``, ``s1t01``, ``t05`` or (1, 9999)."""
    name = col(name)

    def place(code: Column) -> Column:
        numbers = F.split(F.substring(code, F.lit(2), F.length(code)), "t")
        pair = F.struct(F.get(numbers, F.lit(0)).try_cast("int").alias("disc"), F.get(numbers, F.lit(1)).try_cast("int").alias("track"))
        alone = F.struct(F.lit(1).alias("disc"), F.substring(code, F.lit(2), F.length(code)).try_cast("int").alias("track"))
        unknown = F.struct(F.lit(1).alias("disc"), F.lit(9999).alias("track"))
        return F.when(code == EMPTY, unknown).when(code.startswith("t"), alone).otherwise(pair)

    found = [blank_to_null(F.regexp_extract(name, p, 0)) for p in (r"d\d+t\d+", r"s\d+t\d+", r"t\d+")]
    return let(F.coalesce(*found, F.lit(EMPTY)), place)


def track_number(name: Column | str) -> Column:
    """Track number alone: ``t03`` or leading digits, else 9999."""
    name = col(name)
    return F.coalesce(
        digits(F.regexp_extract(name, r"t(\d+)", 1)), digits(F.regexp_extract(name, r"^(\d+)", 1)), F.lit(9999))


# -- durations ----------------------------------------------------------------
def duration_seconds(c: Column | str, strict: bool = False) -> Column:
    """Seconds of ``m:ss`` or a number. Not strict: ``1:02:03`` reads as its prefix."""
    c = col(c)
    clock = r"^\d+:\d{1,2}" + ("$" if strict else "")
    parsed = let(F.regexp_extract(c, clock, 0), lambda m: F.when(
        m != EMPTY, F.substring_index(m, ":", 1).try_cast("double") * 60 + F.substring_index(m, ":", -1).try_cast("double")))
    number = F.when(c.rlike(r"(?U)^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), strip(c).try_cast("double"))
    return F.coalesce(parsed, number)


def duration_display(seconds: Column | str) -> Column:
    whole = F.floor(col(seconds)).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


# -- links and labels ---------------------------------------------------------
def show_url(show_id: Column | str, prefix: str = fixed.SHOW_URL_PREFIX) -> Column:
    show_id = F.coalesce(col(show_id), F.lit(EMPTY))
    return F.when(show_id != EMPTY, F.concat(F.lit(prefix), show_id)).otherwise(EMPTY)


def cap(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def ellipsis(c: Column | str, n: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(cap(c, n), F.lit("..."))).otherwise(c)


def match_context(title: Column | str, body: Column | str, term: Column) -> Column:
    """Text around the first hit, 100 characters before to 300 after; title before body."""

    def window(field: Column) -> Column:
        hit = F.call_function("locate", F.lower(term), F.lower(field))
        start = F.greatest(F.lit(0), hit - 1 - 100)
        return F.when(hit > 0, F.substring(field, start + 1, hit - 1 + 300 - start))

    return F.coalesce(window(col(title)), window(col(body)), F.lit(EMPTY))
