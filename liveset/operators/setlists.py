"""Set lists: from free descriptions and legacy lists to songs, segues and guests.

A description is one value of one row, so it is cut into sets and entries inside the
row: marker positions first, then the lines between two markers. Nothing shuffles and
no window over shows is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liveset import fixed
from liveset.functions.automaton import ASCII_LOWER, automata, bytes_of
from liveset.functions.text import break_lines, clean_html_line, collapse, contains_any, let, strip, unescape
from liveset.scale import checkpoint, collect_bounded, previous_value, running_sum, salted, salted_join

SHOW = "show_identifier"
POSITION = ["set_order", "line_no", "item_no"]
MOST_TITLES = 200_000  # titles that are sent to every task; more are joined

_SET = rf"(?iUd)^(?:{fixed.SET_MARKER})"
_ENCORE = rf"(?iUd)^(?:{fixed.ENCORE_MARKER})"
_ANY_MARKER = rf"(?iU)^(?:{fixed.MARKER_START})"


def _plain(description: Column) -> Column:
    return F.regexp_replace(break_lines(description), r"<[^>]+>", " ")


def _lines(description: Column) -> Column:
    return F.filter(F.transform(F.split(_plain(description), "\n"), strip), lambda x: x != "")


def _set_name(line: Column) -> Column:
    marker = F.regexp_extract(line, _SET, 0)
    digit = F.regexp_extract(marker, "[0-9]", 0)
    return F.when(marker == "", "Encore").when(digit != "", F.concat(F.lit("Set "), digit)).otherwise(marker)


def _marks(lines: str, is_marker) -> Column:
    """Places of the marker lines."""
    return F.filter(F.transform(lines, lambda x, i: F.when(is_marker(x), i)), lambda i: i.isNotNull())


def _found_sets(items: DataFrame, description: str) -> DataFrame:
    """One row per set with its lines; lines before the first marker drop out."""
    between = F.transform(
        "_marks",
        lambda at, k: F.struct(
            k.alias("set_order"),
            _set_name(F.get("_lines", at)).alias("set_name"),
            F.slice("_lines", at + 2, F.coalesce(F.get("_marks", k + 1), F.size("_lines")) - at - 1).alias("body"),
        ),
    )
    return (
        items.select(SHOW, _lines(F.col(description)).alias("_lines"))
        .withColumn("_marks", _marks("_lines", lambda x: x.rlike(_SET) | x.rlike(_ENCORE)))
        .select(SHOW, F.explode(between).alias("s")).select(SHOW, "s.*")
    )


def set_lines(items: DataFrame, description: str = "description") -> DataFrame:
    """One row per text line of a set; set markers and credit lines are gone."""
    return (
        _found_sets(items, description)
        .select(SHOW, "set_order", "set_name", F.posexplode("body").alias("line_no", "line"))
        .filter(~F.col("line").rlike(rf"(?iU)^(?:{fixed.CREDIT_LINE_START})"))
    )


def sets(items: DataFrame, description: str = "description") -> DataFrame:
    """Every set of a show in order, sets without songs included."""
    return _found_sets(items, description).drop("body")


def set_entries(items: DataFrame, description: str = "description") -> DataFrame:
    """One row per comma-separated entry, with its name, segue target and notations."""
    entries = (
        set_lines(items, description)
        .select(SHOW, "set_order", "set_name", "line_no", F.posexplode(F.split("line", ",")).alias("item_no", "raw"))
        .withColumn("raw", strip("raw"))
        .filter((F.col("raw") != "") & ~F.col("raw").rlike(_ANY_MARKER))
    )

    def take_apart(raw: Column) -> Column:
        arrow = F.when(F.contains(raw, F.lit("->")), "->").when(F.contains(raw, F.lit(">")), ">")
        parts = F.when(arrow == "->", F.split(raw, "->")).when(arrow == ">", F.split(raw, ">"))
        return F.struct(
            arrow.isNotNull().alias("transition"),
            F.when(arrow.isNull(), collapse(raw)).otherwise(strip(F.get(parts, F.lit(0)))).alias("head"),
            F.when(arrow.isNotNull(), strip(F.get(parts, F.lit(1)))).alias("next"),
        )

    def note(e: Column) -> Column:
        marks = F.regexp_extract_all(e["head"], F.lit(r"(?U)[*^\d]+(?=\s|$)"), F.lit(0))
        return let(marks, lambda m: F.struct(
            e["transition"].alias("transition"), e["head"].alias("head"), e["next"].alias("next"), m.alias("notations"),
            F.when(F.size(m) > 0, strip(F.regexp_replace(e["head"], r"(?U)[*^\d\s]+$", ""))).otherwise(e["head"]).alias("song_name")))

    return entries.withColumn("e", let(take_apart(F.col("raw")), note)).select(SHOW, *POSITION, "set_name", "e.*")


def show_songs(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("song_name") != "").select(
        SHOW, *POSITION, "set_name", "song_name", "transition", "notations"
    )


def show_transitions(entries: DataFrame) -> DataFrame:
    """Segue pairs: first part of a chain to its second part."""
    return entries.filter("transition").select(
        SHOW, *POSITION, F.col("head").alias("transition_from"), F.col("next").alias("transition_to")
    )


def show_guests(items: DataFrame, description: str = "description") -> DataFrame:
    """Guests named after ``Other artist(s):``, one row each."""
    names = F.regexp_extract(_plain(F.col(description)), r"(?iUd)Other artist\(s\):\s*(.+?)(?:\n|$)", 1)
    return (
        items.select(SHOW, F.posexplode(F.split(names, ",")).alias("guest_no", "guest_artist"))
        .withColumn("guest_artist", strip("guest_artist"))
        .filter(F.col("guest_artist") != "")
    )


def extract_setlists(items: DataFrame, description: str = "description") -> dict[str, DataFrame]:
    entries = set_entries(items, description)
    return {
        "sets": sets(items, description),
        "songs": show_songs(entries),
        "transitions": show_transitions(entries),
        "guests": show_guests(items, description),
    }


# -- legacy lists -------------------------------------------------------------
def segment_titles(text: Column, titles: Sequence[str] = fixed.KNOWN_TITLES) -> Column:
    """Array of song names in a run of titles.

    Known titles are cut out longest first; what lies between them stays as written. A
    title counts where a space, an edge or another title precedes it and a space, ``>``,
    ``&``, an edge or another title follows. All titles are found in one scan of the text by an
    automaton, whatever their number; the plan holds one function.
    """
    cut = _cutter(titles)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(column: pa.Array) -> pa.Array:
        return cut(column)

    return run(strip(text))


def segment_each(texts: Column, titles: Sequence[str] = fixed.KNOWN_TITLES) -> Column:
    """The same for every text of an array: an array of arrays."""
    cut = _cutter(titles)

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(column: pa.Array) -> pa.Array:
        offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), cut(column.flatten()))

    return run(F.transform(texts, strip))


def _cutter(titles: Sequence[str]):
    ranked = sorted(dict.fromkeys(titles), key=len, reverse=True)
    forms = tuple(ASCII_LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes() for t in ranked)
    names = [t.title() for t in ranked]

    def cut(column: pa.Array) -> pa.Array:
        data, offsets = bytes_of(column)
        found = [np.zeros((0, 4), np.int64)]
        for places, one in _built(forms):
            some = one.occurrences(ASCII_LOWER[data], offsets)
            some[:, 3] = places[some[:, 3]]
            found.append(some)
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 1], found[:, 3], found[:, 0]))]
        cuts = np.searchsorted(found[:, 0], np.arange(len(column) + 1))
        raw = data.tobytes()
        return pa.array([
            _segments(raw[offsets[i]:offsets[i + 1]], found[cuts[i]:cuts[i + 1], 1:].tolist(), names) if known else None
            for i, known in enumerate(column.is_valid().to_pylist())], pa.list_(pa.string()))

    return cut


@lru_cache(maxsize=4)
def _built(forms: tuple[bytes, ...]):
    """Automata of some titles, kept while a worker goes from batch to batch. Titles that differ
    in case only are one; the first is its name."""
    first = {f: i for i, f in reversed(list(enumerate(forms)))}
    places = np.array(list(first.values()))
    return [(places[some], one) for some, one in automata(list(first))]


def _segments(text: bytes, found: list[list[int]], names: list[str]) -> list[str]:
    """Names in a text. ``found``: begin, end and rank of titles, longest titles first, each from
    left to right; a title that overlaps a cut one is not there any more."""
    taken: dict[int, tuple[int, int]] = {}  # begin: end, rank
    ends: set[int] = set()
    held = bytearray(len(text))
    for begin, end, rank in found:
        before = begin == 0 or begin in ends or text[begin - 1] == 32
        after = end == len(text) or end in taken or text[end] in b" >&"
        if before and after and not any(held[begin:end]):
            taken[begin] = (end, rank)
            ends.add(end)
            held[begin:end] = b"\1" * (end - begin)
    out, at = [], 0
    for begin in sorted(taken):
        out += [text[at:begin].decode().strip(), names[taken[begin][1]]]
        at = taken[begin][0]
    return [p for p in (*out, text[at:].decode().strip()) if p]


# Pieces of a text: separators one by one, and what lies between them. A title that is cut out
# begins at the start, behind a space or, next to another one, with a separator; it ends at the
# end, before a separator or, next to another one, with a space. So it is a run of whole pieces.
_PIECE, _SEPARATORS = "[^ >&]+|[ >&]", (" ", ">", "&")


def _pieces(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(_PIECE), F.lit(0))


def _shape(pieces: Column) -> Column:
    """How many pieces there are, and whether the first and the last are separators."""
    return F.struct(F.size(pieces).alias("n"), F.get(pieces, F.lit(0)).isin(*_SEPARATORS).alias("head"),
                    F.get(pieces, F.size(pieces) - 1).isin(*_SEPARATORS).alias("tail"))


def _runs(text: Column, shapes: Column) -> Column:
    """Hashes of the runs of pieces that have one of the shapes."""
    def of(pieces: Column) -> Column:
        ends = lambda i, s: (F.get(pieces, i - 1).isin(*_SEPARATORS) == s["head"]) & (
            F.get(pieces, i + s["n"] - 2).isin(*_SEPARATORS) == s["tail"])
        return F.flatten(F.transform(
            F.filter(shapes, lambda s: s["n"] <= F.size(pieces)),
            lambda s: F.transform(F.filter(F.sequence(F.lit(1), F.size(pieces) - s["n"] + 1), lambda i: ends(i, s)),
                                  lambda i: F.xxhash64(F.array_join(F.slice(pieces, i, s["n"]), "")))))

    return let(_pieces(text), of)


def segment_joined(rows: DataFrame, texts: str, titles: DataFrame, out: str, **kw) -> DataFrame:
    """``segment_each`` of an array column ``texts`` as a new column, for titles of any number.

    Every text is cut into pieces at separators, and its runs of pieces meet the titles in
    one equi join of 64-bit hashes: as many runs as places and shapes of titles, whatever the
    number of titles. Equal arrays are joined once. A row then gets the few titles met
    and looks them up in its texts, so equal hashes of other words change nothing.
    """
    given = rows.withColumn(texts, F.transform(texts, strip))
    pieces = _pieces(F.col("title"))
    known = titles.select("title").filter("title <> ''").groupBy(F.array_join(pieces, "").alias("_form")).agg(F.min("title").alias("title"))
    known = checkpoint(known.select("title", F.xxhash64("_form").alias("_run"), _shape(pieces).alias("_shape")))
    # Distinct shapes: at most four for every number of pieces that a title has.
    shapes = F.array(*[F.struct(*[F.lit(s[f]).alias(f) for f in ("n", "head", "tail")])
                       for s in (r["_shape"] for r in known.select("_shape").distinct().collect())])
    lines = given.select(texts).distinct().withColumn("_line", F.xxhash64(texts))
    runs = checkpoint(lines.select("_line", F.explode(F.array_distinct(F.flatten(
        F.transform(texts, lambda x: _runs(F.coalesce(x, F.lit("")), shapes))))).alias("_run")))
    met = salted_join(runs, known.select("_run", "title"), ["_run"], **kw).groupBy("_line").agg(F.collect_set("title").alias("_titles"))

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(column: pa.Array, met: pa.Array) -> pa.Array:
        return pa.array([_cut_each(some or [], found or []) for some, found in zip(column.to_pylist(), met.to_pylist())],
                        pa.list_(pa.list_(pa.string())))

    dealt, copied = salted(given.withColumn("_line", F.xxhash64(texts)), met, ["_line"], **kw)
    joined = dealt.join(copied, ["_line", "_salt"], "left")
    return joined.select(*rows.columns, run(F.col(texts), F.col("_titles")).alias(out))


def _cut_each(texts: list[str | None], titles: list[str]) -> list[list[str] | None]:
    """Names in some texts. ``titles`` differ in more than case."""
    ranked = sorted(titles, key=lambda t: (-len(t), t))
    lower = ASCII_LOWER.tobytes()
    forms, names, out = [t.encode().translate(lower) for t in ranked], [t.title() for t in ranked], []
    for text in texts:
        raw = (text or "").encode()
        low, found = raw.translate(lower), []
        for rank, form in enumerate(forms):
            at = low.find(form)
            while at >= 0:
                found.append([at, at + len(form), rank])
                at = low.find(form, at + 1)
        out.append(None if text is None else _segments(raw, found, names))
    return out


def _few_titles(titles: Sequence[str] | DataFrame, most: int) -> list[str] | None:
    if not isinstance(titles, DataFrame):
        return list(titles)
    rows = collect_bounded(titles.select("title").filter("title <> ''").distinct(), most)
    return None if rows is None else sorted(r["title"] for r in rows)


def known_titles(titles: Sequence[str] | DataFrame, most: int = MOST_TITLES) -> list[str]:
    """Titles as a list; of a table with a column ``title`` after their number is checked."""
    few = _few_titles(titles, most)
    if few is None:
        raise ValueError(f"more than {most} titles")
    return few


def _arrow(c: Column) -> Column:
    return strip(F.replace(c, F.lit("&gt;"), F.lit(">")))


def normalize_legacy(setlists: DataFrame, entries: str = "entries",
                     titles: Sequence[str] | DataFrame = fixed.KNOWN_TITLES, most: int = MOST_TITLES) -> dict[str, DataFrame]:
    """Legacy ``array<string>`` set lists as the same tables as the rich form.

    Entries before any marker belong to a set made on demand. A marker keeps the songs
    on its own line. Lines of players become an attribute of their set. ``titles``: a list, or
    a table with a column ``title``; one of more than ``most`` titles is joined.
    """
    few = _few_titles(titles, most)
    marker = rf"(?iUd)^{fixed.LEGACY_MARKER}\s*(.*)"
    bare = rf"(?iUd)^{fixed.LEGACY_MARKER}"
    lines = F.transform(F.filter(F.col(entries), lambda e: e.isNotNull()), _arrow)

    marks = _marks("_lines", lambda x: x.rlike(bare))
    first = F.coalesce(F.get("_marks", F.lit(0)), F.size("_lines"))
    lead = F.when(
        first > 0,
        F.array(F.struct(F.lit(fixed.LEGACY_DEFAULT_SET).alias("set_name"), F.slice("_lines", F.lit(1), first).alias("body"))),
    ).otherwise(F.array().cast("array<struct<set_name:string,body:array<string>>>"))
    marked = F.transform(
        "_marks",
        lambda at, k: F.struct(
            F.regexp_extract(F.get("_lines", at), marker, 1).alias("set_name"),
            F.concat(
                F.array(strip(F.regexp_extract(F.get("_lines", at), marker, 2))),
                F.slice("_lines", at + 2, F.coalesce(F.get("_marks", k + 1), F.size("_lines")) - at - 1),
            ).alias("body"),
        ),
    )
    body = (
        setlists.select(SHOW, lines.alias("_lines")).withColumn("_marks", marks)
        .select(SHOW, F.posexplode(F.concat(lead, marked)).alias("set_order", "s"))
        .select(SHOW, "set_order", "s.set_name", F.posexplode("s.body").alias("line_no", "line"))
        .withColumn("is_players", F.contains("line", F.lit(" - "))
                    & contains_any(F.lower("line"), fixed.MUSICIAN_WORDS))
    )
    all_sets = (
        body.groupBy(SHOW, "set_order", "set_name")
        .agg(F.max_by(F.when(F.col("is_players"), F.col("line")), F.when(F.col("is_players"), F.col("line_no"))).alias("musicians"))
    )

    segments = F.filter(F.transform(F.split("line", ">"), strip), lambda s: s != "")
    per_segment = F.transform(
        "segments", lambda names, i: F.transform(names, lambda n: F.struct(n.alias("song_name"), (i > 0).alias("transition"))))
    at = [SHOW, "set_order", "set_name", "line_no"]
    played = body.filter(~F.col("is_players"))
    if few is not None:
        cut = played.select(*at, segment_each(segments, few).alias("segments"))
    else:
        cut = segment_joined(played.select(*at, segments.alias("_texts")), "_texts", titles, "segments")
    entry = cut.select(*at, F.flatten(per_segment).alias("names"))
    with_previous = F.transform(
        "names",
        lambda n, i: F.struct(
            n["song_name"].alias("song_name"), n["transition"].alias("transition"),
            F.when(n["transition"] & (i > 0), F.get("names", i - 1)["song_name"]).alias("transition_from"),
        ),
    )
    songs = (
        entry.select(SHOW, "set_order", "set_name", "line_no", F.posexplode(with_previous).alias("item_no", "n"))
        .select(SHOW, *POSITION, "set_name", "n.*")
    )
    return {
        "sets": all_sets,
        "songs": songs.drop("transition_from"),
        "transitions": songs.filter("transition_from is not null").select(
            SHOW, *POSITION, "transition_from", F.col("song_name").alias("transition_to")
        ),
    }


def legacy_description(setlists: DataFrame, entries: str = "entries") -> DataFrame:
    """Raw description of a legacy list: its last line of players, else its first marker."""
    lines = F.transform(F.filter(F.col(entries), lambda e: e.isNotNull()), _arrow)
    marker = rf"(?iUd)^{fixed.LEGACY_MARKER}"
    players = F.filter("_lines", lambda x: F.contains(x, F.lit(" - "))
                       & contains_any(F.lower(x), fixed.MUSICIAN_WORDS) & ~x.rlike(marker))
    marks = F.filter("_lines", lambda x: x.rlike(marker))
    return setlists.select(SHOW, lines.alias("_lines")).select(
        SHOW,
        F.coalesce(F.get(players, F.size(players) - 1), F.get(marks, F.lit(0)), F.lit("")).alias("raw_description"),
    )


# -- flat readings ------------------------------------------------------------
def flat_songs(items: DataFrame, description: str = "description", decode=unescape) -> DataFrame:
    """Every comma- and arrow-separated part of a description, in order."""
    return (
        items.withColumn("_flat", clean_html_line(description, decode))
        .select(SHOW, F.posexplode(F.split("_flat", ",")).alias("item_no", "item"))
        .select(SHOW, "item_no", F.posexplode(F.split("item", "->")).alias("part_no", "song_name"))
        .withColumn("song_name", strip("song_name"))
        .filter(F.col("song_name") != "")
    )


def ordered_songs(items: DataFrame, description: str = "description") -> DataFrame:
    """Base songs in order: credits, crew and marker lines skipped, text before an arrow kept."""
    marker = rf"(?iU)^(?:{fixed.MARKER_START})"
    skip = lambda c: contains_any(F.lower(c), fixed.SKIP_PHRASES)
    base = strip(F.get(F.split(_arrow(F.replace(F.col("item"), F.lit("&lt;"), F.lit("<"))), "->|>"), F.lit(0)))
    return (
        items.select(SHOW, F.posexplode(_lines(F.col(description))).alias("line_no", "line"))
        .filter(~F.col("line").rlike(marker) & ~skip(F.col("line")))
        .select(SHOW, "line_no", F.posexplode(F.split("line", ",")).alias("item_no", "item"))
        .withColumn("item", strip("item"))
        .filter((F.col("item") != "") & ~F.col("item").rlike(marker))
        .withColumn("song_name", base)
        .filter(F.col("song_name") != "")
        .select(SHOW, "line_no", "item_no", "song_name")
    )


# -- ordered tables -----------------------------------------------------------
def set_numbers(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_boundary: Column,
                out: str = "set_no", **kw) -> DataFrame:
    """Set number of each row: how many boundary rows came up to it."""
    return running_sum(rows, keys, order, is_boundary.cast("long"), out, **kw)


def transitions_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], song: str,
                         segue: Column | None = None, **kw) -> DataFrame:
    """Pairs of a song with its predecessor, for rows that follow a segue mark."""
    paired = previous_value(rows, keys, order, song, "transition_from", **kw)
    keep = F.col("transition_from").isNotNull()
    if segue is not None:
        keep &= segue
    return paired.filter(keep).withColumn("transition_to", F.col(song))


def legacy_or_rich(setlists: DataFrame, value: str = "value") -> DataFrame:
    """Counts of both set list shapes in the raw map values."""
    text = F.ltrim(F.col(value))
    return setlists.agg(
        F.count_if(text.startswith("{")).alias("rich"),
        F.count_if(text.startswith("[")).alias("legacy"),
        F.count(F.lit(1)).alias("setlists"),
    )

