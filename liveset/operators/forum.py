"""Forum posts and message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.dates import title_show_date
from liveset.functions.text import cap, col, contains_any, strip

NODE = ("struct<kind:string,data:struct<id:string,body:string,author:string,score:int,"
        "created_utc:double,replies:string>>")
LISTING = f"struct<data:struct<children:array<{NODE}>>>"


def classify_posts(posts: DataFrame, title: str = "title", body: str = "selftext") -> DataFrame:
    """Labels of a post; ``general`` when none applies. Show threads go by title only."""
    low_title, low_body = F.lower(title), F.lower(F.coalesce(F.col(body), F.lit("")))

    def label(name: str) -> Column:
        phrases = fixed.POST_LABELS[name]
        return F.when(contains_any(low_title, phrases) | contains_any(low_body, phrases), name)

    dated = low_title.rlike(r"\d{4}-\d{2}-\d{2}") | low_title.rlike(r"gd\d{4}")
    labels = F.array_compact(F.array(label("setlist"), label("review"), F.when(dated, "show_thread"), label("song")))
    return posts.withColumn("categories", F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("general"))))


def with_show_date(posts: DataFrame, title: str = "title") -> DataFrame:
    return posts.withColumn("show_date", title_show_date(title))


def flatten_replies(posts: DataFrame, children: str = "comments", max_depth: int = fixed.REPLY_MAX_DEPTH,
                    cap_rows: int | None = None, body_cap: int | None = None) -> DataFrame:
    """Comment trees as rows in reading order, all of them and whole unless
    ``cap_rows`` and ``body_cap`` say less (``fixed.REPLY_CAP``, ``fixed.REPLY_BODY_CAP`` in
    the established harvest).

    ``replies`` is empty or a nested listing, so it is read as text and parsed again per
    level. A tree is one value of its row: the walk needs no shuffle. Other node kinds are
    left out with their subtrees.
    """

    held = (lambda c: c) if body_cap is None else (lambda c: cap(c, body_cap))

    def row(node: Column, depth: int) -> Column:
        d = node["data"]
        return F.struct(
            d["id"].alias("id"), held(F.coalesce(d["body"], F.lit(""))).alias("body"),
            F.coalesce(d["author"], F.lit("[deleted]")).alias("author"),
            F.coalesce(d["score"], F.lit(0)).alias("score"),
            F.coalesce(d["created_utc"], F.lit(0.0)).alias("created_utc"), F.lit(depth).alias("depth"))

    def walk(nodes: Column, depth: int) -> Column:
        comments = F.filter(nodes, lambda n: n["kind"] == "t1")

        def visit(node: Column) -> Column:
            here = F.array(row(node, depth))
            if depth == max_depth:
                return here
            replies = F.from_json(node["data"]["replies"], LISTING)["data"]["children"]
            return F.concat(here, F.coalesce(walk(replies, depth + 1), F.slice(here, 1, 0)))

        return F.flatten(F.transform(comments, visit))

    keys = [c for c in posts.columns if c != children]
    rows = walk(F.col(children), 0)
    first = rows if cap_rows is None else F.slice(rows, 1, cap_rows)
    return (
        posts.select(*keys, F.posexplode(first).alias("comment_no", "c"))
        .select(*keys, "comment_no", "c.*")
    )


def parse_messages(messages: DataFrame, text: str = "text", mention: str | None = None) -> DataFrame:
    """Action and question of a message; anything without a known action is a question."""
    said = F.col(text)
    if mention:
        said = F.regexp_replace(said, mention, " ")
    said = strip(F.regexp_replace(strip(said), rf"(?iU)^{fixed.COMMAND_PREFIX}\b", ""))
    form = r'(?sU)^(\w+)\s+"?(.+?)"?$'
    action = F.lower(F.regexp_extract(said, form, 1))
    known = action.isin(*fixed.ACTIONS)
    return messages.withColumn("action", F.when(known, action).otherwise(F.lit("ask"))).withColumn(
        "question", F.when(known, strip(F.regexp_extract(said, form, 2))).otherwise(said))


def route_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Route and arguments by prefix (``song:"..."``); no prefix means vector search.

    ``a -> b`` splits into two arguments only when there are exactly two parts.
    """
    q = col(text)
    prefix = F.coalesce(*[F.when(q.startswith(f"{r}:"), r) for r in fixed.ROUTES])
    rest = F.regexp_replace(strip(F.substring(q, F.length(prefix) + 2, F.length(q))), r'^"+|"+$', "")
    parts = F.split(rest, "->")
    pair = (prefix == "transition") & (F.size(parts) == 2)
    return questions.withColumn("route", F.coalesce(prefix, F.lit("vector"))).withColumn(
        "arg1", F.when(prefix.isNull(), q).when(pair, strip(F.get(parts, F.lit(0)))).otherwise(rest)
    ).withColumn("arg2", F.when(pair, strip(F.get(parts, F.lit(1)))))
