"""Date columns: show keys, free-text date phrases, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.text import blank_to_null, col, digits, let, words

def _ymd(c: Column, pattern: str) -> Column:
    """Year, month and day of the first match of a dashed date; short years pivot."""

    def read(found: Column) -> Column:
        parts = F.split(F.regexp_replace(found, "[^0-9-]", ""), "-")
        year = F.get(parts, F.lit(0)).try_cast("int")
        return F.when(found != "", F.struct(
            F.when(year >= 100, year).when(year > fixed.CENTURY_PIVOT, 1900 + year).otherwise(2000 + year).alias("year"),
            F.get(parts, F.lit(1)).try_cast("int").alias("month"), F.get(parts, F.lit(2)).try_cast("int").alias("day")))

    return let(F.regexp_extract(c, pattern, 0), read)


def show_date(show_id: Column | str, type_: Column | str | None = None,
              created: Column | str | None = None) -> Column:
    """``struct(year, month, day)`` of a show key.

    Two-digit years pivot at 30. Rows typed ``setlist_song`` fall back to ``created``.
    """
    parts = _ymd(col(show_id), r"\d{2,4}-\d{2}-\d{2}")
    if type_ is None or created is None:
        return parts
    fallback = F.when(col(type_) == "setlist_song", _ymd(col(created), r"^\d{4}-\d{2}-\d{2}"))
    return F.coalesce(parts, fallback)


def show_date_key(show_id: Column | str) -> Column:
    """``YYYY-MM-DD`` of a four-digit-year show key, else null."""
    return blank_to_null(F.regexp_extract(col(show_id), r"gd(\d{4}-\d{2}-\d{2})", 1))


def show_year(show_id: Column | str) -> Column:
    return show_date(show_id)["year"]


def long_date(c: Column | str) -> Column:
    """``YYYY-MM-DD`` as ``Month DD, YYYY``; empty is ``unknown``, anything else stays."""
    c = col(c)
    day = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "y-M-d"))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "unknown")
        .otherwise(F.coalesce(F.date_format(day, "MMMM dd, yyyy"), c))
    )


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _month(word: Column) -> Column:
    """Month of a name; only its first three letters decide."""
    return F.try_element_at(_lookup({m[:3]: n for m, n in fixed.MONTHS.items()}), F.substring(word, 1, 3))


def number_word(c: Column | str) -> Column:
    """Day number of a word or a tens-and-ones pair, else null."""
    table = _lookup(fixed.NUMBER_WORDS)

    def read(parts: Column) -> Column:
        first = F.try_element_at(table, F.get(parts, F.lit(0)))
        second = F.try_element_at(table, F.get(parts, F.lit(1)))
        return F.when(F.size(parts) == 1, first).when((first >= 20) & (second <= 9), first + second)

    return let(words(F.replace(F.lower(col(c)), F.lit("-"), F.lit(" "))), read)


def _parts(month: Column, day: Column, year: Column | None = None) -> Column:
    year = F.lit(None).cast("int") if year is None else year
    return F.struct(year.alias("year"), month.alias("month"), day.alias("day"))


def parse_date_phrase(question: Column | str, today: Column) -> Column:
    """First date a question names, as ``struct(year, month, day)``; year may be null.

    Forms are tried in order and only the first hit of each is looked at: today,
    Y-M-D, M/D, M-D, month name with number, month name with number word. The text of a
    hit is found once per form and taken apart on its own.
    """
    names = "|".join(sorted(fixed.MONTHS, key=len, reverse=True))
    numeric = r"(?U)\b[A-Za-z]{3,9}\s+\d{1,2}(?:st|nd|rd|th)?(?:\s*,?\s*\d{4})?\b"
    worded = rf"(?U)\b(?:{names})\s+[a-z]+(?:[\s-][a-z]+)?(?:\s*,?\s*\d{{4}})?\b"

    def short(found: Column, mark: str) -> Column:
        month, day = digits(F.substring_index(found, mark, 1)), digits(F.substring_index(found, mark, -1))
        return F.when((found != "") & month.between(1, 12) & day.between(1, 31), _parts(month, day))

    def full(found: Column) -> Column:
        parts = F.split(found, "-")
        return F.when(found != "", _parts(*[F.get(parts, F.lit(i)).try_cast("int") for i in (1, 2, 0)]))

    def named(found: Column, day_pattern: str, read) -> Column:
        year = digits(F.regexp_extract(found, r"(\d{4})$", 1))
        both = F.when(found != "", F.struct(_month(found).alias("m"), read(F.regexp_extract(found, day_pattern, 1)).alias("d")))
        return let(both, lambda b: F.when(b["m"].isNotNull() & b["d"].between(1, 31), _parts(b["m"], b["d"], year)))

    def forms(q: Column) -> Column:
        low = F.lower(q)
        now = _parts(F.month(today), F.dayofmonth(today), F.year(today))
        return F.coalesce(
            F.when(low.rlike(r"(?U)\btoday\b"), now),
            let(F.regexp_extract(q, r"\d{4}-\d{1,2}-\d{1,2}", 0), full),
            let(F.regexp_extract(q, r"(?<![\d/])\d{1,2}/\d{1,2}(?![\d/])", 0), lambda m: short(m, "/")),
            let(F.regexp_extract(q, r"(?<![\d-])\d{1,2}-\d{1,2}(?![\d-])", 0), lambda m: short(m, "-")),
            let(F.regexp_extract(low, numeric, 0), lambda m: named(m, r"(?U)^[a-z]+\s+(\d{1,2})", digits)),
            let(F.regexp_extract(low, worded, 0), lambda m: named(m, r"(?U)^[a-z]+\s+([a-z]+(?:[\s-][a-z]+)?)", number_word)),
        )

    return let(col(question), forms)


def resolve_today(question: Column | str, today: Column) -> Column:
    """Replace the word ``today`` with the long date of ``today``."""
    pieces = F.split(col(question), r"(?iU)\btoday\b", -1)
    return F.call_function("array_join", pieces, F.date_format(today, "MMMM dd, yyyy"))


def title_show_date(title: Column | str) -> Column:
    """Date text of a forum title as written; patterns are tried in order."""
    title = col(title)
    return F.coalesce(*[blank_to_null(F.regexp_extract(title, "(?i)" + p, 0)) for p in fixed.POST_DATE_PATTERNS])
