"""Tables landed in the shapes the readers take, one document a line, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.queries import query
from liveset.scale import scratch_path
from liveset.sources import readers
from liveset.sources.sinks import write_corpus

SHOW = "show_identifier"


def _key(column: str, mark: str = "d"):
    return F.concat(F.lit(mark), F.col(column).cast("string"))


def _lines(df: DataFrame, name: str) -> str:
    """Write a frame's only column, JSON texts, a line each."""
    path = scratch_path(df.sparkSession, name)
    df.toDF("value").write.text(path)
    return path


@query("SELECT 'd' || doc_id AS show_identifier, text AS comment_text, n_chars::INT AS rating, source || '|' || lang AS entries, 'd' || doc_id AS processed FROM documents")
def landed_corpus(t):
    """Combined corpus files: comments, legacy set lists and processed keys."""
    docs = t.documents.select(
        F.array(F.struct(_key("doc_id").alias(SHOW), F.col("text").alias("comment_text"), F.col("n_chars").alias("rating"))).alias("comments"),
        F.create_map(_key("doc_id"), F.to_json(F.array("source", "lang"))).alias("setlists"), F.array(_key("doc_id")).alias("shows_processed"))
    parts = readers.read_corpus(t.spark, _lines(docs.select(F.to_json(F.struct("*"))), "corpus"), multi_line=False)
    lists = parts["setlists_legacy"].select(SHOW, F.array_join("entries", "|").alias("entries"))
    done = parts["shows_processed"].select(SHOW, F.col(SHOW).alias("processed"))
    return parts["comments"].select(SHOW, "comment_text", "rating").join(lists, SHOW).join(done, SHOW)


@query("""
SELECT 'd' || doc_id AS show_identifier, CASE WHEN lang <> 'en' OR doc_id % 2 = 1 THEN text END AS comment_text, 'rows' AS section FROM documents
UNION ALL SELECT NULL, text, 'lyrics' FROM documents WHERE lang <> 'en' UNION ALL SELECT 'd' || doc_id, source, 'setlists' FROM documents WHERE lang <> 'en'
UNION ALL SELECT 'd' || doc_id, CASE WHEN doc_id % 2 = 1 THEN text END, 'lyrics' FROM documents WHERE lang = 'en'""")
def landed_index(t):
    """Index files in both layouts; rows of a list may lack their text."""
    row = F.struct(F.lit("comment").alias("type"), _key("doc_id").alias(SHOW), F.when((F.col("lang") != "en") | (F.col("doc_id") % 2 == 1), F.col("text")).alias("comment_text"))
    named = F.struct(F.array(row).alias("comments"), F.array(F.struct(F.col("text").alias("comment_text"))).alias("lyrics"), F.create_map(_key("doc_id"), F.col("source")).alias("setlists"))
    lines = t.documents.select(F.when(F.col("lang") == "en", F.to_json(F.array(row))).otherwise(F.to_json(named)))
    parts = readers.read_index(t.spark, _lines(lines, "index"), multi_line=False)
    told = lambda name: parts[name].select(SHOW, "comment_text", F.lit(name).alias("section"))
    return told("rows").unionByName(told("lyrics")).unionByName(parts["setlists"].select(SHOW, F.col("value").alias("comment_text"), F.lit("setlists").alias("section")))


@query("""SELECT 'd' || doc_id AS key, CASE WHEN lang = 'de' THEN 'd' || doc_id ELSE source END AS title, text AS lyrics_text, lang AS lyricist FROM documents""")
def landed_lyrics(t):
    """Lyrics maps; the key stands in for a missing title, other values drop out."""
    song = F.struct(F.when(F.col("lang") != "de", F.col("source")).alias("title"), F.col("text").alias("lyrics_text"), F.array("lang").alias("lyricists"))
    lines = t.documents.select(F.to_json(F.create_map(_key("doc_id"), song))).union(t.labels.select(F.to_json(F.create_map(_key("doc_id", "l"), F.lit("no entry")))))
    got = readers.read_lyrics(t.spark, _lines(lines, "lyrics"), multi_line=False)
    return got.select("key", "title", "lyrics_text", F.element_at("lyricists", 1).alias("lyricist"))


@query("SELECT 'gd' || l_orderkey AS show_identifier, 'p' || l_partkey AS song, l_quantity::DOUBLE AS duration_seconds, l_linenumber::VARCHAR AS track_file FROM lineitem")
def landed_durations(t):
    """Duration lists."""
    row = F.struct(_key("l_orderkey", "gd").alias("show_id"), _key("l_partkey", "p").alias("song"), F.col("l_quantity").alias("duration_seconds"), F.col("l_linenumber").cast("string").alias("track_file"))
    path = _lines(t.lineitem.select(F.to_json(F.array(row))), "durations")
    return readers.read_durations(t.spark, path, multi_line=False).select(SHOW, "song", "duration_seconds", "track_file")


@query(f"""
SELECT conv_id || '-' || turn AS id, role AS title, text[1:{fixed.POST_BODY_CAP}] AS selftext, '[deleted]' AS author, '{fixed.POST_URL_PREFIX}/r/' || conv_id AS permalink,
  strftime(to_timestamp(turn * 86400), '%Y-%m-%d') AS created FROM conversations WHERE role <> 'system'""")
def landed_posts(t):
    """Post listings; untitled posts drop out."""
    post = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("role") != "system", F.col("role")).alias("title"), F.col("text").alias("selftext"),
                    F.concat(F.lit("/r/"), F.col("conv_id").cast("string")).alias("permalink"), (F.col("turn") * 86400.0).alias("created_utc"))
    line = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("t3").alias("kind"), post.alias("data"))).alias("children")).alias("data")))
    got = readers.read_posts(t.spark, _lines(t.conversations.select(line), "posts"), body_cap=fixed.POST_BODY_CAP, multi_line=False)
    return got.select("id", "title", "selftext", "author", "permalink", "created")


@query("SELECT conv_id || '-' || turn AS id, 1 AS n_comments, text AS body FROM conversations")
def landed_threads(t):
    """Thread files: a post and its comment tree."""
    node = lambda kind, **data: F.struct(F.lit(kind).alias("kind"), F.struct(*[v.alias(k) for k, v in data.items()]).alias("data"))
    listing = lambda n: F.to_json(F.struct(F.struct(F.array(n).alias("children")).alias("data")))
    key = F.concat_ws("-", "conv_id", "turn")
    line = F.concat(F.lit("["), listing(node("t3", id=key)), F.lit(","), listing(node("t1", id=key, body=F.col("text"), replies=F.lit(""))), F.lit("]"))
    got = readers.read_threads(t.spark, _lines(t.conversations.select(line), "threads"), multi_line=False)
    return got.select("id", F.size("comments").alias("n_comments"), F.get("comments", F.lit(0))["data"]["body"].alias("body"))


@query("SELECT url, html FROM pages")
def landed_pages(t):
    """The page table, written and read by its columns."""
    path = scratch_path(t.spark, "pages")
    write_corpus(t.pages, path)
    return readers.read_pages(t.spark, path)


@query("SELECT doc_id::VARCHAR AS song_name, CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status, 'T' || toxic AS tag FROM labels")
def stored_decisions(t):
    """Decisions kept in their store."""
    none = F.lit(None).cast("string")
    rows = t.labels.select(F.col("doc_id").cast("string").alias("song_name"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("status"),
                           _key("toxic", "T").alias("tag"), none.alias("primary_vocalist"), none.alias("decided_at"))
    path = scratch_path(t.spark, "decisions")
    write_corpus(rows, path)
    return readers.read_decisions(t.spark, path).select("song_name", "status", "tag")


@query("SELECT DISTINCT 'gd' || o_custkey AS show_identifier FROM orders")
def listed_ids(t):
    """Identifiers of landed search pages, each once."""
    page = F.struct(F.struct(F.lit(1).alias("numFound"), F.lit(0).alias("start"), F.array(F.struct(_key("o_custkey", "gd").alias("identifier"))).alias("docs")).alias("response"))
    return readers.listing_ids(readers.read_listing(t.spark, _lines(t.orders.select(F.to_json(page)), "listing"), multi_line=False))


@query("SELECT doc_id AS staged_no_of, 'x' || doc_id AS song_name, lang AS tag FROM documents")
def landed_staging(t):
    """Staged inferences."""
    row = F.struct(F.array(F.struct(_key("doc_id", "x").alias("song_name"), F.col("lang").alias("tag"), F.col("doc_id").cast("int").alias("year"))).alias("inferences"))
    got = readers.read_staging(t.spark, _lines(t.documents.select(F.to_json(row)), "staging"), multi_line=False)
    return got.select(F.col("year").cast("long").alias("staged_no_of"), "song_name", "tag")
