"""Searches over the corpus: substrings, song names, dates, combined results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import from_arrow_type

from liveset.functions.automaton import CELLS, automata, bytes_of
from liveset.functions.dates import parse_date_phrase, show_date
from liveset.functions.text import cap, loose_key, match_context, words
from liveset.operators.merge import top_per_key
from liveset.operators.vectors import knn, knn_filtered
from liveset.scale import HOT_ROWS, checkpoint, collect_bounded, copy_over, deal, row_ordinal, salt_marks, salted_join

MAX_LITERAL_TERMS = 16
#: Terms sent to every task, in bytes, each counted with what its question takes beside it.
MAX_SCANNED_BYTES, ROW_BYTES = 4 << 20, 32
HITS_A_BATCH = 8192
HELD_ROWS = 200_000
GRAM = 8
DEALS = 64
LYRIC_TYPES = ("lyric", "interpretation")
DATE_SCORE = 1.0
#: Scores by common words that questions are answered down to in turn, and words that stand last.
LEVELS, HEAVY_WORDS = (0.25, 0.0), 100


# -- one term -----------------------------------------------------------------
def _holds(c: str, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower()))


def _first(df: DataFrame, k: int | None, order: Sequence[str]) -> DataFrame:
    return df if k is None else df.orderBy(*order).limit(k)


def search_songs(corpus: DataFrame, song: str, k: int | None = 20, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Set songs whose name holds the term; ``k=None`` keeps every match."""
    return _first(corpus.filter((F.col("type") == "setlist_song") & _holds("song_name", song)), k, order)


def search_guests(corpus: DataFrame, guest: str, k: int | None = 10, order: Sequence[str] = ("row_id",)) -> DataFrame:
    return _first(corpus.filter((F.col("type") == "guest_artist") & _holds("guest_artist", guest)), k, order)


def search_transitions(corpus: DataFrame, from_song: str, to_song: str | None = None, k: int | None = 10,
                       order: Sequence[str] = ("row_id",)) -> DataFrame:
    hits = corpus.filter((F.col("type") == "transition") & _holds("transition_from", from_song))
    if to_song is not None:
        hits = hits.filter(_holds("transition_to", to_song))
    return _first(hits, k, order)


def search_transcripts(transcripts: DataFrame, term: str, k: int | None = 10, order: Sequence[str] = ("url",)) -> DataFrame:
    """Transcripts naming the term in title or body, with context and preview."""
    hits = transcripts.filter(_holds("title", term) | _holds("transcript", term))
    return (
        _first(hits, k, order)
        .withColumn("context", match_context("title", "transcript", F.lit(term)))
        .withColumn("full_text", cap("transcript", 500))
    )


def _literal(value, kind: T.DataType) -> Column:
    """A value as a column, structs field by field."""
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


# -- term batches -------------------------------------------------------------
def substring_hits(texts: DataFrame, terms: DataFrame, text: str, term: str = "term",
                   max_terms: int = MAX_LITERAL_TERMS, max_bytes: int = MAX_SCANNED_BYTES, keep: Sequence[str] | None = None,
                   where: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every (text row, term) where the lower-cased text holds the lower-cased term; an empty
    term is in every text, a null one in none.

    ``terms``: question_id and ``term``. Up to ``max_terms`` they become a literal array
    checked in the scan. Up to ``max_bytes``, counted before they are fetched, they become an
    automaton that every task runs over its texts once; nothing is exchanged. Beyond that texts
    and terms meet on character runs: a term is filed under its first ``GRAM`` characters, a
    text under all runs of the lengths that occur, and hits are verified. Only the text's key
    and the runs are exchanged, the text itself is looked up for hits alone. All three ways
    return the same rows, with the columns of ``texts`` or those of them to ``keep``: a long
    text that nobody needs again should not be repeated for every hit.

    ``where`` makes of the question_id a condition on the kept columns that hits meet besides.
    With few terms it goes down to where the texts are read, as the terms do.
    """
    given = list(keep or texts.columns)
    meets = where or (lambda _: F.lit(True))
    asked = terms.select("question_id", F.lower(term).alias("_term")).filter(F.col("_term").isNotNull())
    rows = collect_bounded(asked, max_terms)
    if rows is not None:
        if not rows:
            return texts.select(*given, F.lit(None).cast(terms.schema["question_id"].dataType).alias("question_id")).filter(F.lit(False))
        kind = asked.schema["question_id"].dataType
        wanted = F.array(*[F.struct(_literal(r["question_id"], kind).alias("question_id"), F.lit(r["_term"]).alias("t")) for r in rows])
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        # Said as a plain condition, it goes down to where the texts are read: only hits get their other columns.
        held = reduce(lambda a, b: a | b, [meets(_literal(r["question_id"], kind)) & F.contains(low, F.lit(r["_term"])) for r in rows])
        return (
            texts.filter(held).withColumn("_low", low)
            .withColumn("_hit", F.explode(F.filter(wanted, lambda w: F.contains(F.col("_low"), w["t"]))))
            .select(*given, F.col("_hit.question_id")).filter(meets(F.col("question_id")))
        )
    size = asked.agg(F.coalesce(F.sum(F.octet_length("_term") + ROW_BYTES), F.lit(0))).first()[0]
    if size <= max_bytes:
        return scan_terms(texts, asked.toArrow(), text, keep=given).filter(meets(F.col("question_id")))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    keyed = texts.withColumn("_key", F.md5(low))  # equal texts are searched once
    # Every text holds the empty term; its rows are dealt over many keys.
    deal = F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))
    every = asked.filter("_term = ''").select("question_id", deal.alias("_deal"))
    everywhere = keyed.withColumn("_deal", F.pmod(F.xxhash64("_key"), F.lit(DEALS)).cast("int")).join(every, "_deal")
    filed = asked.filter("_term <> ''").withColumn("_n", F.least(F.length("_term"), F.lit(GRAM))).withColumn(
        "_gram", F.substring("_term", F.lit(1), F.col("_n")))
    sizes = F.broadcast(filed.select("_n").distinct())  # GRAM rows at most
    runs = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_low") - F.col("_n") + 1), lambda i: F.substring("_low", i, F.col("_n"))))
    distinct = keyed.groupBy("_key").agg(F.any_value(low).alias("_low"))
    grams = (
        distinct.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(GRAM))))
        .join(sizes, "_n", "left_semi").filter(F.length("_low") >= F.col("_n"))
        .select("_key", "_n", F.explode(runs).alias("_gram"))
    )
    met = grams.join(filed, ["_n", "_gram"]).select("_key", "question_id", "_term")
    held = keyed.join(met, "_key").filter(F.contains(low, F.col("_term")))
    columns = [*given, "question_id"]
    return held.select(*columns).unionByName(everywhere.select(*columns)).filter(meets(F.col("question_id")))


def scan_terms(texts: DataFrame, asked: pa.Table, text: str, cells: int = CELLS, keep: Sequence[str] | None = None) -> DataFrame:
    """The same by automata over the bytes of the lower-cased texts: one look-up a byte,
    however many terms there are. ``asked`` has question_id and ``_term``; terms beyond
    ``cells`` of one automaton go to a further one in the same scan."""
    asked = asked.combine_chunks()
    given = asked.column("_term").cast(pa.binary()).to_pylist()
    distinct = sorted(set(given))
    number = {t: i for i, t in enumerate(distinct)}
    of_row = np.array([number[t] for t in given], np.int64)
    by_term = np.argsort(of_row, kind="stable")
    cuts = np.searchsorted(of_row[by_term], np.arange(len(distinct) + 1))
    questions = asked.column("question_id").take(pa.array(by_term))
    everywhere = number.get(b"")

    def run(batches):
        found = automata([t for t in distinct if t], cells)
        shift = 0 if everywhere is None else 1  # the empty term comes first and is in no automaton
        for batch in batches:
            data, offsets = bytes_of(batch.column("_low"))
            at, term = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for places, one in found:
                t, k = one.find(data, offsets)
                at.append(t)
                term.append(places[k] + shift)
            if shift:
                at.append(np.arange(batch.num_rows))
                term.append(np.zeros(batch.num_rows, np.int64))
            at, term = np.concatenate(at), np.concatenate(term)
            sizes = cuts[term + 1] - cuts[term]
            at = np.repeat(at, sizes)
            asker = np.repeat(cuts[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            kept = batch.select(columns)
            for lo in range(0, len(at), HITS_A_BATCH):
                part = kept.take(pa.array(at[lo:lo + HITS_A_BATCH]))
                ids = questions.take(pa.array(asker[lo:lo + HITS_A_BATCH])).combine_chunks()
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*columns, "question_id"])

    columns = list(keep or texts.columns)
    schema = T.StructType([*[texts.schema[c] for c in columns], T.StructField("question_id", from_arrow_type(questions.type))])
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return texts.select(*columns, low.alias("_low")).mapInArrow(run, schema)


# -- first k and how many there are -------------------------------------------
def first_with_total(hits: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, str]], k: int,
                     held_rows: int = HELD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first ``k`` rows of every key with their ``rank``, and ``total``, how many the key has.

    One pass: every task holds a bounded list and a count a key, and hands on at most ``k`` rows
    a key with the count on the first; lists merge the same way after the shuffle. A task that
    holds more than ``held_rows`` hands on what it has and begins anew. ``order``: (column,
    "ascending" or "descending"), nulls first and last as in Spark; rows with equal order are
    taken in any order, so it should end with a unique column.

    No task can hold a list of more than ``held_rows``: with such a ``k`` the hits are stored once and
    numbered by ranges (``row_ordinal``), so a key on many rows is shared by several tasks.
    """
    keys = list(keys)
    if k > held_rows:
        return _numbered_with_total(hits, keys, order, k, hot_rows)
    sorting = [(c, way, "at_start" if way == "ascending" else "at_end") for c, way in [*[(c, "ascending") for c in keys], *order]]

    def shortened(table: pa.Table) -> pa.Table:
        for c, way, nulls in reversed(sorting):  # stable, the last key first
            table = table.take(pc.sort_indices(table, sort_keys=[(c, way)], null_placement=nulls))
        n = table.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for c in keys:
            values = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        count = np.add.reduceat(table.column("_n").to_numpy(), start) if n else np.zeros(0, np.int64)
        place = np.arange(n) - start[group] if n else np.zeros(0, np.int64)
        counts = np.where(place == 0, count[group] if n else 0, 0)
        table = table.set_column(table.schema.get_field_index("_n"), "_n", pa.array(counts.astype(np.int64)))
        return table.filter(pa.array(place < k))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(shortened(pa.Table.from_batches([batch])))
            size += held[-1].num_rows
            if size > held_rows:
                held = [shortened(pa.concat_tables(held))]
                size = held[0].num_rows
                if size > held_rows // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from shortened(pa.concat_tables(held)).to_batches()

    counted = hits.withColumn("_n", F.lit(1).cast("long"))
    lists = counted.mapInArrow(run, counted.schema)
    by = W.partitionBy(*keys)
    wanted = [F.asc(c) if way == "ascending" else F.desc(c) for c, way in order]
    return (lists.withColumn("rank", F.row_number().over(by.orderBy(*wanted)))
            .withColumn("total", F.sum("_n").over(by)).filter(F.col("rank") <= k).drop("_n"))


def _numbered_with_total(hits: DataFrame, keys: list[str], order: Sequence[tuple[str, str]], k: int, hot_rows: int) -> DataFrame:
    stored = checkpoint(hits)
    totals = checkpoint(stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")))
    ranked = row_ordinal(stored, keys, [F.asc(c) if way == "ascending" else F.desc(c) for c, way in order], "rank", hot_rows)
    marks = salt_marks(totals, keys, hot_rows, rows="total")
    few = copy_over(totals, marks, keys).select(*[F.col(c).alias(f"_t_{c}") for c in [*keys, "_salt"]], "total")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in [*keys, "_salt"]])
    return deal(ranked.filter(F.col("rank") <= k), marks, keys).join(few, same).select(
        *hits.columns, F.col("rank").cast("int").alias("rank"), "total")


# -- song names with scores ---------------------------------------------------
def lyric_scores(names: DataFrame, questions: DataFrame, name: str = "song_name", question: str = "question") -> DataFrame:
    """Score of every distinct name against every question, zero scores left out.

    1.0 for equal keys, 0.8 where one holds the other, else half the share of common
    words. Pairs come from a shared word or from holding; no pair scores otherwise, so
    names and questions are never all crossed.
    """
    n = names.select(F.col(name).alias("song_name")).distinct().withColumn("nm", loose_key("song_name")).filter("nm != ''")
    keys = n.select("nm").distinct()
    q = questions.select("question_id", loose_key(question).alias("q"))
    asked = q.select("q").distinct().filter("q != ''")
    shared = (
        keys.select("nm", F.explode(F.array_distinct(words("nm"))).alias("w"))
        .join(asked.select("q", F.explode(F.array_distinct(words("q"))).alias("w")), "w")
        .select("nm", "q")
    )
    holds = _containments(keys.select(F.col("nm").alias("long")), asked.select(F.col("q").alias("part"))).select(
        F.col("long").alias("nm"), F.col("part").alias("q"))
    held = _containments(asked.select(F.col("q").alias("long")), keys.select(F.col("nm").alias("part"))).select(
        F.col("part").alias("nm"), F.col("long").alias("q"))
    pairs = shared.unionByName(holds).unionByName(held).distinct()
    return _scored_pairs(pairs).filter("score > 0").join(q, "q").join(n, "nm").select("question_id", "song_name", "score")


def best_names(names: DataFrame, questions: DataFrame, k: int, name: str = "song_name", question: str = "question",
               levels: Sequence[float] = LEVELS) -> DataFrame:
    """``lyric_scores`` of all names that can be among a question's ``k`` best.

    A prefix-filtered set join, from the highest score down. Words are ordered rarest first. To
    score ``s`` by common words a name must share ``2 s`` of the words of the longer side, so
    both sides are filed under the few first words that such a pair cannot all miss. A question
    is safe, and asks no further, once ``k`` names score the level or more: no name that is
    still unmet can. The last of ``levels`` is 0, any common word. Frequent words stand last and are reached only by questions that rarer
    ones leave short. Equal and holding names are found at the start, whatever their words.
    """
    n = names.select(F.col(name).alias("song_name")).distinct().withColumn("nm", loose_key("song_name")).filter("nm != ''")
    keys = checkpoint(n.select("nm").distinct())
    q = questions.select("question_id", loose_key(question).alias("q"))
    asked = checkpoint(q.select("q").distinct().filter("q != ''"))
    counts = keys.select(F.explode(F.array_distinct(words("nm"))).alias("w")).groupBy("w").count()
    heavy = [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(HEAVY_WORDS).collect()][::-1]
    name_words, asked_words = _rarest_first(keys, "nm", heavy), _rarest_first(asked, "q", heavy)
    holds = substring_hits(keys, asked.select(F.col("q").alias("question_id"), F.col("q").alias("term")), "nm").select(
        "nm", F.col("question_id").alias("q"))
    held = _containments(asked.select(F.col("q").alias("long")), keys.select(F.col("nm").alias("part"))).select(
        F.col("part").alias("nm"), F.col("long").alias("q"))
    met = checkpoint(_scored_pairs(holds.unionByName(held).distinct()))
    pending = asked_words
    for level in levels:
        shared = filed_words(name_words, "nm", level).join(filed_words(pending, "q", level), "w").select("nm", "q").distinct()
        met = checkpoint(met.unionByName(_scored_pairs(shared)).distinct())
        if level == levels[-1]:
            break
        safe = met.filter(F.col("score") >= level).groupBy("q").count().filter(F.col("count") >= k).select("q")
        pending = checkpoint(pending.join(safe, "q", "left_anti"))
        if not pending.limit(1).count():
            break
    return met.filter("score > 0").join(q, "q").join(n, "nm").select("question_id", "song_name", "score")


def _rarest_first(df: DataFrame, text: str, heavy: list[str]) -> DataFrame:
    """Text, its distinct words with the frequent ones last, and how many words it has."""
    order = F.array(*[F.lit(w) for w in heavy]).cast("array<string>")
    ranked = F.array_sort(F.transform(F.array_distinct(words(text)), lambda w: F.struct(F.array_position(order, w).alias("at"), w.alias("w"))))
    return df.select(text, F.transform(ranked, lambda x: x["w"]).alias("ws"), F.size(words(text)).alias("size"))


def filed_words(ranked: DataFrame, text: str, level: float) -> DataFrame:
    """The words under which a text is filed for scores of ``level`` or more: all but as many as
    it must share, less one. A text that cannot share enough is not filed."""
    size = F.col("size") if text == "nm" else F.size("ws")
    needed = F.greatest(F.ceil(2 * level * size - 1e-9), F.lit(1)).cast("int")
    return ranked.select(text, F.explode(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - needed + 1, F.lit(0)))).alias("w"))


def _scored_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of name key and question key with their score."""
    common = F.size(F.array_intersect(words("q"), words("nm")))
    most = F.greatest(F.size(F.array_distinct(words("q"))), F.size(words("nm")), F.lit(1))
    return pairs.select("nm", "q", (
        F.when(F.col("nm") == F.col("q"), F.lit(1.0))
        .when(F.contains("nm", F.col("q")) | F.contains("q", F.col("nm")), F.lit(0.8))
        .otherwise(F.lit(0.5) * common / most)).alias("score"))


def _containments(longs: DataFrame, parts: DataFrame, gram: int = GRAM) -> DataFrame:
    """Pairs where ``long`` holds ``part``, met on the first characters of the part."""
    filed = parts.distinct().withColumn("_n", F.least(F.length("part"), F.lit(gram))).withColumn(
        "_gram", F.substring("part", F.lit(1), F.col("_n")))
    sizes = F.broadcast(filed.select("_n").distinct())  # GRAM rows at most
    runs = (
        longs.distinct().withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(gram))))
        .join(sizes, "_n", "left_semi").filter(F.length("long") >= F.col("_n"))
        .withColumn("_gram", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("long") - F.col("_n") + 1),
            lambda i: F.substring("long", i, F.col("_n"))))))
    )
    return runs.join(filed, ["_n", "_gram"]).filter(F.contains("long", F.col("part"))).select("long", "part").distinct()


def search_lyrics(corpus: DataFrame, questions: DataFrame, k: int = 15, types: Sequence[str] = LYRIC_TYPES,
                  question: str = "question", overfetch: bool = False, **kw) -> DataFrame:
    """Lyric and note rows for a song: name matches by score, topped up with near vectors.

    ``questions``: question_id, ``question`` and, for the top-up, embedding. Final score is
    1 minus a thousandth per place.
    """
    rows = corpus.filter(F.col("type").isin(*types))
    named = rows.filter(F.coalesce("song_name", F.lit("")) != "").select("row_id", "song_name")
    # All rows of a name score alike and ties go by row id, so k rows a name are enough.
    first = top_per_key(named, ["song_name"], ["row_id"], k, "_place").drop("_place")
    scored = best_names(named, questions, k, question=question).join(first, "song_name").select(
        "question_id", "row_id", F.lit(0).alias("stage"), (-F.col("score")).alias("order"))
    scored = top_per_key(scored, ["question_id"], ["order", "row_id"], k, "_place").drop("_place")
    if "embedding" in questions.columns:
        near = knn_filtered(corpus, questions, k, F.col("type").isin(*types), overfetch, **kw)
        near = near.join(scored.select("question_id", "row_id"), ["question_id", "row_id"], "left_anti")
        scored = scored.unionByName(near.select("question_id", "row_id", F.lit(1).alias("stage"), F.col("score").alias("order")))
    best = top_per_key(scored, ["question_id"], ["stage", "order", "row_id"], k)
    return best.select("question_id", "row_id", (1 - (F.col("rank") - 1) * 0.001).alias("score"), "rank")


# -- dates --------------------------------------------------------------------
def with_show_date(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("show_date", show_date("show_identifier", "type", "created"))


def search_by_date(corpus: DataFrame, questions: DataFrame, today: Column, question: str = "question", **kw) -> DataFrame:
    """Rows of shows on the date a question names; without a year, of every year. There are 366
    dates at most, so those on many rows are split over tasks."""
    asked = _dates(questions, "question_id", parse_date_phrase(question, today)).withColumnRenamed("year", "asked_year")
    dated = _dates(corpus, "row_id", show_date("show_identifier", "type", "created"))
    return (
        salted_join(dated, asked, ["month", "day"], **kw)
        .filter(F.col("asked_year").isNull() | (F.col("asked_year") == F.col("year")))
        .select("question_id", "row_id", F.lit(DATE_SCORE).alias("score"))
    )


def _dates(df: DataFrame, key: str, date: Column) -> DataFrame:
    """Key, year, month and day of the rows that have a date."""
    return df.select(key, F.inline(F.array_compact(F.array(date))))


# -- combining ----------------------------------------------------------------
def without_earlier(hits: DataFrame, earlier: DataFrame) -> DataFrame:
    return hits.join(earlier.select("question_id", "row_id"), ["question_id", "row_id"], "left_anti")


def combine_hits(*parts: tuple[str, DataFrame], **kw) -> DataFrame:
    """Several result lists as one, earlier lists first, each row once per question.

    A part is (kind, hits with question_id, row_id, score); lists keep their own order,
    by ``rank`` where they have one and by row id otherwise. Scores of different kinds do
    not compare, hence ``score_kind`` and an explicit rank.
    """
    stacked = reduce(lambda a, b: a.unionByName(b), [
        hits.select("question_id", "row_id", F.col("score").cast("double").alias("score"), F.lit(kind).alias("score_kind"),
                    F.lit(i).alias("_part"),
                    (F.col("rank").cast("long") if "rank" in hits.columns else F.lit(0).cast("long")).alias("_place"))
        for i, (kind, hits) in enumerate(parts)])
    once = stacked.groupBy("question_id", "row_id").agg(
        F.min(F.struct("_part", "_place", "score", "score_kind")).alias("h")).select("question_id", "row_id", "h.*")
    # Sizes are looked at before ranking; the searches must not run twice for that.
    ranked = row_ordinal(checkpoint(once), ["question_id"], ["_part", "_place", "row_id"], "rank", **kw)
    return ranked.select("question_id", "row_id", "score", "score_kind", "rank")


def hybrid_search(corpus: DataFrame, questions: DataFrame, k: int, today: Column, question: str = "question", **kw) -> DataFrame:
    """Nearest rows, then rows of the date a question names."""
    return combine_hits(("distance", knn(corpus, questions, k)), ("date", search_by_date(corpus, questions, today, question)), **kw)


def combined_search(corpus: DataFrame, questions: DataFrame, k: int, today: Column, lyric_k: int = 5, question: str = "question", **kw) -> DataFrame:
    """Nearest rows, then rows of the date a question names, then lyric and note rows of the song
    it names, each row once, under its first list."""
    return combine_hits(
        ("distance", knn(corpus, questions, k)), ("date", search_by_date(corpus, questions, today, question)),
        ("lexical", search_lyrics(corpus, questions.drop("embedding"), lyric_k, question=question)), **kw)
