"""HTML page tables: links, indexes, track tables, transcripts, song pages.

Pages are an input table of ``(url, html)``. Each page is read inside its row with
regexes on the JVM; only entity decoding visits Python, and only for texts with ``&``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.text import blank_to_null, col, collapse, digits, drop_tags, has_text, let, song_key, strip, unescape, words
from liveset.functions.urls import canonical_url, is_internal, resolve_url, url_part
from liveset.scale import first_per_key

_LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
_HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"


def _all(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def page_hrefs(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.posexplode(_all("html", _HREF)).alias("link_no", "href"))


def extract_page_links(pages: DataFrame, host: str | None = None) -> DataFrame:
    """Canonical links between pages of one site (``host``, or each page's own)."""
    target = F.col("absolute")
    return (
        page_hrefs(pages).withColumn("absolute", resolve_url("url", "href"))
        .filter(is_internal("absolute", host if host is not None else url_part("url", "host")))
        .select(F.col("url").alias("page"), canonical_url("url").alias("source"), "link_no", canonical_url(target).alias("target"))
    )


def extract_title_index(pages: DataFrame, pattern: str, first_wins: bool = False, base: str = "",
                        page_order: str = "url", decode=unescape) -> DataFrame:
    """Song key to slug (or link) from pages of links.

    ``pattern`` has two groups, link and title. Of several links with one key the last
    counts, or the first where ``first_wins``. With ``base`` the whole link is kept.
    """
    found = F.arrays_zip(_all("html", pattern, 1).alias("href"), _all("html", pattern, 2).alias("title"))
    slug = F.concat(F.lit(base), F.col("l.href")) if base else F.substring_index("l.href", "/", -1)
    rows = (
        pages.select(F.col(page_order).alias("_page"), F.posexplode(found).alias("_no", "l"))
        .select("_page", "_no", slug.alias("slug"), strip(decode(drop_tags("l.title"))).alias("title"))
        .filter(F.col("title") != "")
        .withColumn("song_key", song_key("title", None))
    )
    pick = F.min_by if first_wins else F.max_by
    return rows.groupBy("song_key").agg(pick("slug", F.struct("_page", "_no")).alias("slug"))


def extract_links(pages: DataFrame, pattern: str = fixed.EPISODE_LINK_PATTERN) -> DataFrame:
    """Links whose target fits a pattern: absolute, first titled occurrence of each."""
    found = F.arrays_zip(_all("html", _LINK, 1).alias("href"), _all("html", _LINK, 2).alias("text"))
    rows = (
        pages.select("url", F.posexplode(found).alias("link_no", "l"))
        .filter(F.col("l.href").rlike(pattern))
        .select(F.col("url").alias("page"), "link_no", resolve_url("url", "l.href").alias("url"),
                strip(F.regexp_replace("l.text", r"<[^>]+>", "")).alias("title"))
        .filter(F.col("title") != "")
    )
    return first_per_key(rows, ["url"], ["page", "link_no"])


def extract_track_table(pages: DataFrame, decode=unescape) -> DataFrame:
    """Numbered two-column table rows: track number and title; the last duplicate wins."""
    rows = _all(F.array_join(_all("html", r"(?s)<table[^>]*>(.*?)</table>"), "\n"), r"(?s)<tr[^>]*>(.*?)</tr>")
    cells = F.transform(
        _all(F.col("row"), r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), lambda c: strip(F.regexp_replace(c, r"<[^>]+>", "")))
    title = F.replace(F.replace(decode(F.get("cells", F.lit(1))), F.lit(">"), F.lit("")), F.lit("&gt;"), F.lit(""))
    return (
        pages.select("url", F.posexplode(rows).alias("row_no", "row"))
        .withColumn("cells", cells).filter(F.size("cells") == 2)
        .withColumn("track_number", digits(F.regexp_extract(F.get("cells", F.lit(0)), r"^[+]?\d+$", 0)))
        .filter(F.col("track_number") >= 1)
        .withColumn("title", strip(title))
        .groupBy("url", "track_number")
        .agg(F.min("row_no").alias("listing_no"), F.max_by("title", "row_no").alias("title"))
    )


def _inner_text(html: Column, opening: Column) -> Column:
    """Text of the element that starts with ``opening`` (place and tag name): up to the tag
    that closes it, whatever is nested inside; to the end where none does."""

    def inside(tail: Column, name: Column) -> Column:
        tag = F.concat(F.lit(r"(?is)</?"), name, F.lit(r"\b[^>]*>"))
        step = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"))

        def walk(at: Column, found: Column) -> Column:
            closed = (at["used"] > 0) & (at["depth"] == 0)
            depth = at["depth"] + F.when(found.startswith("</"), -1).otherwise(1)
            return F.when(closed, at).otherwise(F.struct(depth.alias("depth"), (at["used"] + 1).alias("used")))

        end = F.aggregate(F.regexp_extract_all(tail, F.concat(F.lit("("), tag, F.lit(")")), F.lit(1)), step, walk)
        pieces = F.split(tail, tag, -1)
        return let(end, lambda e: F.array_join(F.slice(pieces, F.lit(2), F.when(
            e["depth"] == 0, e["used"] - 1).otherwise(F.size(pieces))), ""))

    return let(F.substring(html, opening["at"], F.length(html)), lambda tail: F.regexp_replace(
        inside(tail, opening["name"]), r"<[^>]+>", ""))


def extract_transcripts(pages: DataFrame, decode=unescape) -> DataFrame:
    """Transcript of an episode page: the first known block with all it holds, nested or
    not; its long paragraphs where there is none or where it is empty."""

    def block(mark: str) -> Column:
        tag = rf"(?is)<(div|section|article|p)\b[^>]*\b{mark}[^>]*>"
        at = F.regexp_instr("html", F.lit(tag))
        return F.when(at > 0, F.struct(at.alias("at"), F.regexp_extract("html", tag, 1).alias("name")))

    blocks = [block(rf"class\s*=\s*[\"'](?:[^\"']*\s)?{c}(?=[\s\"'])[^\"']*[\"']") for c in fixed.TRANSCRIPT_CLASSES]
    blocks += [block(rf"id\s*=\s*[\"']{i}[\"']") for i in fixed.TRANSCRIPT_IDS]
    paragraphs = F.filter(
        F.transform(_all("html", r"(?is)<p\b[^>]*>(.*?)</p>"), lambda p: strip(F.regexp_replace(p, r"<[^>]+>", ""))),
        lambda p: F.length(p) > 50,
    )
    known = let(F.coalesce(*blocks), lambda b: F.when(b.isNotNull(), _inner_text(F.col("html"), b)))
    chosen = F.coalesce(F.when(F.length(known) > 0, known), F.array_join(paragraphs, "\n\n"))
    # Decoding runs on a generated column: its argument must not be inlined into it.
    return (
        pages.withColumn("_chosen", F.explode(F.array(chosen)))
        .withColumn("transcript", strip(decode(F.col("_chosen")))).drop("_chosen")
        .filter(has_text("transcript"))
        .withColumn("word_count", F.size(words("transcript")))
        .drop("html")
    )


# -- song pages, field blocks -------------------------------------------------
_ANCHOR = 'class="node__content"'
_FIELD_END = r'class="[^"]*field--name-field-|</article>'


def _after_anchor(doc: Column) -> Column:
    at = F.instr(doc, _ANCHOR)
    return F.when(at > 0, F.substring(doc, at, F.length(doc))).otherwise(doc)


def _field_block(doc: Column, field: str) -> Column:
    start = rf'<div class="[^"]*(?:field--name-field-{field}|field--name-{field})(?=["\s])'
    return F.regexp_extract(doc, rf"(?s){start}(.*?)(?:{_FIELD_END}|\z)", 1)


def _field_items(block: Column, decode=unescape) -> Column:
    """Items of a field, decoded together in one call, without their note marks."""
    raw = F.array_join(_all(block, r'<div class="field__item">([^<]*)</div>'), "\u0001")
    values = F.transform(
        F.split(decode(raw), "\u0001", -1), lambda v: strip(F.regexp_replace(strip(v), r"(?iU)\s*\(note \w+\)\s*$", "")))
    return F.filter(values, lambda v: v != "")


def _without_scripts(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<(style|script)\b.*?</\1>", " ")


def _body_block(doc: Column) -> Column:
    """First body block that holds prose rather than styles, scripts or site notices."""
    opening = r'<div class="[^"]*field--name-body(?=["\s])'
    pieces = F.split(F.regexp_replace(doc, opening, "\u0001"), "\u0001", -1)
    tails = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda i: F.regexp_extract(
            F.array_join(F.slice(pieces, i + 1, F.size(pieces)), '<div class="field--name-body'),
            rf"(?s)^(.*?)(?:{_FIELD_END}|\z)", 1))

    def prose(block: Column) -> Column:
        text = collapse(F.regexp_replace(drop_tags(_without_scripts(block)), r"&#?\w+;", "?"))
        braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
        return (F.length(text) > 40) & (braces < 3) & ~text.rlike("(?i)" + fixed.BOILERPLATE_PATTERN)

    found = F.when(F.size(pieces) > 1, F.filter(tails, prose))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def extract_song_pages_a(pages: DataFrame, page_url: Column | None = None, decode=unescape) -> dict[str, DataFrame]:
    """Song pages built of field blocks: ``songs`` (one row a page), ``interpretations``.

    Columns in: slug, html. A note counts when it is numbered or longer than 15 characters.
    """
    doc = _after_anchor(F.col("html"))
    head = F.substring_index(drop_tags(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)), "|", 1)
    lyrics = _field_block(doc, "lyrics")
    label = '<div class="field__label">Lyrics</div>'
    after_label = F.when(F.contains(lyrics, F.lit(label)),
                         F.substring(lyrics, F.instr(lyrics, label) + len(label), F.length(lyrics))).otherwise(lyrics)
    text = F.regexp_replace(decode(drop_tags(after_label)), r"[ \t]+\n", "\n")
    first_played = r"(?iU)first played[^.]*?(\d{1,2}\s+\w{3,9}\s+\d{4}|\d{4})"
    songs = pages.select(
        "slug",
        F.coalesce(blank_to_null(strip(decode(head))), F.col("slug")).alias("title"),
        _field_items(_field_block(doc, "lyrics-by"), decode).alias("lyricists"),
        _field_items(_field_block(doc, "music-by"), decode).alias("music_by"),
        strip(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("lyrics_text"),
        blank_to_null(F.regexp_extract("html", first_played, 1)).alias("first_played_hint"),
    )
    body = F.regexp_replace(_without_scripts(_body_block(doc)), r"^[^<]*>", "")
    paragraphs = _all("body", r"(?s)<p[^>]*>(.*?)</p>")
    note = F.regexp_replace(collapse(decode(drop_tags("part"))), r"(?U)\s*<[^>]*$", "")
    url = F.col("slug") if page_url is None else page_url
    notes = (
        pages.withColumn("body", body).filter(F.col("body") != "")
        .select("slug", url.alias("url"), F.posexplode(
            F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.array("body"))).alias("note_no", "part"))
        .withColumn("text", note)
        .filter(F.col("text").rlike(r"^\(\d+\)") | (F.length("text") > 15))
        .select("slug", "note_no", F.lit(fixed.SOURCE_FIELDS).alias("source"), "text", "url")
    )
    return {"songs": songs, "interpretations": notes}


# -- song pages, plain text ---------------------------------------------------
def _credits(line: Column) -> Column:
    names = F.transform(F.split(line, r"[,/&]| and "),
                        lambda n: strip(F.regexp_replace(strip(n), r"(?U)\s*\(note \w+\)\s*$", "")))
    return F.filter(names, lambda n: n != "")


def extract_song_pages_b(pages: DataFrame, decode=unescape) -> dict[str, DataFrame]:
    """Song pages in plain text: credit lines, lyrics up to the notes, lettered notes.

    Columns in: url, html. A note shorter than 11 characters is dropped.
    """
    plain = F.regexp_replace(decode(drop_tags("html")), r"[ \t]+", " ")
    plain = F.regexp_replace(plain, r"(?U)\n\s*\n+", "\n")
    rows = pages.withColumn("_title", decode(drop_tags(F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1)))
                            ).withColumn("_text", plain)
    lyrics = strip(F.regexp_extract("_text", rf"(?mdU)^\s*Music:\s*[^\n]+\n((?s:.*?))(?={fixed.LYRIC_END})", 1))
    songs = rows.select(
        "url", F.coalesce(blank_to_null(strip("_title")), F.col("url")).alias("title"),
        _credits(F.regexp_extract("_text", r"(?mdU)^\s*Lyrics:\s*(.+)$", 1)).alias("lyricists"),
        _credits(F.regexp_extract("_text", r"(?mdU)^\s*Music:\s*(.+)$", 1)).alias("music_by"),
        F.when(lyrics.isin(*fixed.INSTRUMENTAL_LABELS), "").otherwise(lyrics).alias("lyrics_text"),
        F.lit(None).cast("string").alias("first_played_hint"),
    )
    block = F.regexp_extract("_text", rf"(?s)\nNotes\n(.*?)(?={fixed.NOTES_END}|\z)", 1)
    notes = (
        rows.select("url", F.posexplode(F.split(strip(block), r"(?U)\n(?=\(\w+\))")).alias("note_no", "part"))
        .select("url", "note_no", F.lit(fixed.SOURCE_PLAIN).alias("source"), collapse("part").alias("text"))
        .filter(F.length("text") > 10)
    )
    return {"songs": songs, "interpretations": notes}
