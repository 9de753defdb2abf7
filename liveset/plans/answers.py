"""Answering question batches: one job per route, each over its own questions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset.operators.durations import known_venues, top_durations, with_venue
from liveset.operators.forum import route_questions
from liveset.operators.merge import top_per_key
from liveset.operators.search import first_with_total, substring_hits
from liveset.operators.vectors import knn
from liveset.scale import checkpoint

LIMITS = {"song": 20, "guest": 10, "transition": 10, "deadcast": 10, "ep": 20, "vector": 20}
#: Hits whose ids are sent to every task, counted before.
MOST_SENT = 100_000


#: Type and searched column of the routes that look for a term.
TERM_ROUTES = {
    "song": ("setlist_song", "song_name"), "guest": ("guest_artist", "guest_artist"),
    "transition": ("transition", "transition_from"), "deadcast": ("deadcast_transcript", "text"),
}
CORPUS_ORDER = ("section", "position", "chunk_index", "row_id")


def term_routes(corpus: DataFrame, routed: DataFrame, limits: dict, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """First rows of every question that names a term, and how many rows hold it.

    All four routes share one scan of the corpus: the terms of all questions are looked for in
    the column that the row's type is searched by, each in rows of its own route's type only.
    """
    types, fields = [t for t, _ in TERM_ROUTES.values()], [f for _, f in TERM_ROUTES.values()]
    asked = routed.filter(F.col("route").isin(*TERM_ROUTES)).select(F.struct("question_id", "route", "arg2").alias("question_id"), F.col("arg1").alias("term"))
    searched = F.coalesce(*[F.when(F.col("type") == t, F.col(f)) for t, f in TERM_ROUTES.values()])
    shown = list(dict.fromkeys(["row_id", "type", "transition_to", *order, *keep]))
    rows = corpus.filter(F.col("type").isin(*types)).select(*shown, searched.alias("_searched"))

    def meets(q: Column) -> Column:
        own = F.coalesce(*[F.when(q["route"] == r, F.col("type") == t) for r, (t, _) in TERM_ROUTES.items()])
        return own & ((F.col("type") != "transition") | q["arg2"].isNull() | F.contains(F.lower("transition_to"), F.lower(q["arg2"])))

    hits = substring_hits(rows, asked, "_searched", keep=shown, where=meets).withColumnRenamed("question_id", "_q")
    kept = hits.select("_q.question_id", "_q.route", *dict.fromkeys(["row_id", *order, *keep]))
    best = first_with_total(kept, ["question_id", "route"], [(c, "ascending") for c in order], max(limits[r] for r in TERM_ROUTES))
    within = F.coalesce(*[F.when(F.col("route") == r, F.col("rank") <= limits[r]) for r in TERM_ROUTES])
    return best.filter(within).select("question_id", "row_id", F.lit(0.0).alias("score"), "rank", "total", "route", *keep)


def duration_route(corpus: DataFrame, questions: DataFrame, k: int, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The ranking is the same for every such question: ``k`` rows paired with each."""
    top = top_durations(corpus.filter(F.col("type") == "ep_duration"), k, tie_break=tuple(order)).select(
        *dict.fromkeys(["row_id", "duration_seconds", *order, *keep]), F.lit(0.0).alias("score"))
    ranked = top_per_key(top.withColumn("route", F.lit("ep")), ["route"], [F.desc("duration_seconds"), *order], k)
    return questions.filter(F.col("route") == "ep").select("question_id", "route").join(
        F.broadcast(ranked.select("route", "row_id", "score", "rank", *keep)), "route").drop("route")  # k rows


def answer_batch(corpus: DataFrame, questions: DataFrame, question: str = "question", limits: dict | None = None,
                 order: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Hits of every question by its own route: question_id, row_id, score, rank, total, route.

    Questions without a prefix need an ``embedding``. Rows that only match come in corpus
    order, as far as the corpus has its columns, or in that of ``order``. ``total`` counts all
    rows that match, beside the first few that are given; rankings by length or distance have
    none. ``keep``: columns of the corpus that hits bring along, so that it need not be read again
    for them; those of the nearest rows are looked up among the rows that have a vector.
    """
    limits = {**LIMITS, **(limits or {})}
    order = [c for c in order or CORPUS_ORDER if c in corpus.columns]
    routed = route_questions(questions, question)
    parts = {
        "terms": term_routes(corpus, routed, limits, order, keep),
        "ep": duration_route(corpus, routed, limits["ep"], order, keep).withColumn("route", F.lit("ep")),
    }
    if "embedding" in questions.columns and "embedding" in corpus.columns:
        near = knn(corpus, routed.filter(F.col("route") == "vector"), limits["vector"])
        near = with_rows(near, corpus.filter(F.col("embedding").isNotNull()).select("row_id", *keep)) if keep else near
        parts["vector"] = near.withColumn("route", F.lit("vector"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())


def with_rows(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits with their rows. Identical rows share an id and one of them is shown.

    Hits are stored, since they are used twice; as long as they are few, their ids go to the tasks
    and the corpus is not exchanged.
    """
    hits = checkpoint(hits)
    ids = hits.select("row_id").distinct()
    wanted = corpus.join(F.broadcast(ids) if hits.count() <= MOST_SENT else ids, "row_id", "left_semi")
    rest = [c for c in corpus.columns if c != "row_id"]
    rows = wanted.groupBy("row_id").agg(F.any_value(F.struct(*rest)).alias("r")).select("row_id", "r.*")
    return hits.join(rows, "row_id")


def top_with_venues(durations: DataFrame, k: int, undated: str | Column = "") -> DataFrame:
    """Longest performances with their venues; the lookup sees only the ``k`` rows."""
    return with_venue(top_durations(durations, k), known_venues(durations.sparkSession), undated)
