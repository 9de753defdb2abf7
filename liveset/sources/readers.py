"""Readers: landed JSON, JSON lines, page tables and parquet to DataFrames.

A missing file reads as an empty table. Whole-file JSON documents are one row each, so a
collection should land as many files (or JSON lines) rather than one; every reader takes
a folder or glob.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liveset import fixed
from liveset.functions.text import blank_to_null, cap, has_text
from liveset.operators.forum import NODE
from liveset.sources import schemas

SHOW = "show_identifier"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(schema))


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON by schema with the file name, which orders files for first-wins merging."""
    if not _exists(spark, path):
        return _empty(spark, schema).withColumn("_file", F.lit(""))
    rows = spark.read.schema(schema).json(path, multiLine=multi_line)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped by the source."""
    return read_json(spark, path, schema, multi_line=False).drop("_file")


def read_corpus(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Combined corpus files as tables: comments, rich and legacy set lists, processed
    keys, transcripts. A set list value is an object or a list; its first character tells."""
    raw = read_json(spark, path, schemas.COMBINED, multi_line)

    def section(name: str) -> DataFrame:
        return raw.select(F.col("_file").alias("file_no"), F.posexplode(name).alias("pos", "r"))

    lists = raw.select(F.col("_file").alias("file_no"), F.posexplode("setlists").alias("pos", SHOW, "value"))
    text = F.ltrim(F.col("value"))
    rich = lists.filter(text.startswith("{")).withColumn("s", F.from_json("value", schemas.RICH_SETLIST))
    legacy = lists.filter(text.startswith("[")).withColumn("entries", F.from_json("value", schemas.LEGACY_SETLIST))
    return {
        "comments": section("comments").select("file_no", "pos", "r.*"),
        "setlists": lists,
        "setlists_rich": rich.select("file_no", "pos", SHOW, "s.*"),
        "setlists_legacy": legacy.select("file_no", "pos", SHOW, "entries"),
        "shows_processed": section("shows_processed").select("file_no", "pos", F.col("r").alias(SHOW)),
        "deadcast_transcripts": section("deadcast_transcripts").select("file_no", "pos", "r.*"),
    }


def read_items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Landed item documents, one a file or one a line; fields that may be text or list
    arrive as text."""
    return read_json(spark, path, schemas.ITEMS, multi_line).drop("_file").withColumn(
        SHOW, F.col("metadata.identifier"))


def read_listing(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Landed search pages: one row per page, for year completeness and ids."""
    return read_json(spark, path, schemas.LISTING_PAGE, multi_line).select(
        "_file", F.col("response.numFound").alias("num_found"), F.col("response.start").alias("start"), "response.docs")


def listing_ids(pages: DataFrame) -> DataFrame:
    return pages.select(F.posexplode("docs").alias("pos", "d")).select(F.col("d.identifier").alias(SHOW)).distinct()


def read_index(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Corpus index in either layout: a list of rows, or an object with named sections.

    A list reads as one row per element and an object as one row with section columns;
    sections that are absent are empty.
    """
    sections = (
        f"comments array<struct<{schemas.INDEX_ROW}>>, lyrics array<struct<{schemas.INDEX_ROW}>>, setlists map<string,string>, "
        f"deadcast_transcripts array<struct<{schemas.TRANSCRIPT}>>, ep_durations array<struct<{schemas.DURATIONS}>>"
    )
    raw = read_json(spark, path, f"{sections}, {schemas.INDEX_ROW}", multi_line)
    row_cols = [f.name for f in T.StructType.fromDDL(schemas.INDEX_ROW).fields]
    # An object has section columns and no row columns; rows of a list may lack any of theirs.
    named = [F.col(c).isNotNull() for c in ("comments", "lyrics", "setlists", "deadcast_transcripts", "ep_durations")]
    listed = raw.filter(~reduce(lambda a, b: a | b, named)).select(*row_cols)

    def section(name: str) -> DataFrame:
        return raw.select(F.explode(name).alias("r")).select("r.*")

    return {
        "rows": listed.unionByName(section("comments")),
        "lyrics": listed.unionByName(section("lyrics")),
        "setlists": raw.select(F.explode("setlists").alias(SHOW, "value")),
        "deadcast_transcripts": section("deadcast_transcripts"),
        "durations": section("ep_durations"),
    }


def read_lyrics(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Lyrics map as one row per song; non-object values drop out, the key stands in for a
    missing title."""
    if not _exists(spark, path):
        return _empty(spark, schemas.LYRICS).withColumn("key", F.lit(""))
    raw = spark.read.text(path, wholetext=multi_line).select(F.from_json("value", "map<string,string>").alias("m"))
    return (
        raw.select(F.explode("m").alias("key", "value"))
        .filter(F.ltrim("value").startswith("{"))
        .withColumn("s", F.from_json("value", f"struct<{schemas.LYRICS}>")).filter("s is not null")
        .select("key", "s.*").withColumn("title", F.coalesce(blank_to_null("title"), F.col("key")))
    )


def read_durations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_json(spark, path, schemas.DURATIONS, multi_line).drop("_file").withColumnRenamed("show_id", SHOW)


def read_songlist(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, f"songs array<struct<{schemas.SONGLIST}>>").select(
        F.explode("songs").alias("s")).select("s.*")


def read_posts(spark: SparkSession, path: str, body_cap: int | None = None, multi_line: bool = True) -> DataFrame:
    """Posts of listing pages; untitled ones drop out. Bodies are whole unless ``body_cap``
    (``fixed.POST_BODY_CAP`` in the established harvest) holds them to a length."""
    held = (lambda c: c) if body_cap is None else (lambda c: cap(c, body_cap))
    rows = read_json(spark, path, schemas.POST_LISTING, multi_line).select(F.explode("data.children").alias("c")).select("c.data.*")
    return (
        rows.filter(has_text("title"))
        .withColumn("selftext", held(F.coalesce(F.col("selftext"), F.lit(""))))
        .withColumn("author", F.coalesce("author", F.lit("[deleted]")))
        .withColumn("permalink", F.concat(F.lit(fixed.POST_URL_PREFIX), F.coalesce("permalink", F.lit(""))))
        .withColumn("created", F.date_format(F.timestamp_seconds(F.coalesce("created_utc", F.lit(0.0))), "yyyy-MM-dd"))
    )


def read_threads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Thread files: a list of two listings, the post and its comment tree."""
    raw = spark.read.text(path, wholetext=multi_line).select(
        F.from_json("value", "array<struct<data:struct<children:array<string>>>>").alias("t")) if _exists(spark, path) else None
    if raw is None:
        return _empty(spark, f"id string, comments array<{NODE}>")
    post = F.from_json(F.get(F.get("t", F.lit(0))["data"]["children"], F.lit(0)), "struct<data:struct<id:string>>")
    nodes = F.transform(F.get("t", F.lit(1))["data"]["children"], lambda c: F.from_json(c, NODE))
    return raw.select(post["data"]["id"].alias("id"), nodes.alias("comments"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("url", "html")


def read_staging(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_json(spark, path, schemas.STAGING, multi_line).select(F.posexplode("inferences").alias("staged_no", "i")).select(
        "staged_no", "i.*")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DECISIONS).parquet(path) if _exists(spark, path) else _empty(spark, schemas.DECISIONS)


def read_graph_csv(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema("url string, depth int, in_degree int, out_degree int").csv(nodes, header=True),
        spark.read.schema("source string, target string, source_depth int, target_depth int").csv(edges, header=True),
    )
