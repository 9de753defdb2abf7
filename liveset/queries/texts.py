"""Corpus assembly, chunks, embeddings and formatted rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from liveset.operators import metrics
from liveset.operators import versions as V
from liveset.operators.chunks import chunk_words
from liveset.operators.format import (
    answer_line, chat_line, context_line, digest_line, lyric_card, message_line, note_line, result_line, tool_line,
)
from liveset.operators.vectors import HashingEncoder, embed, refresh_vectors
from liveset.plans import corpus as U
from liveset.queries import query
from liveset.scale import scratch_path
from liveset.sources.sinks import write_vectors

SHOW = "show_identifier"

WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
CHUNKS_SQL = f"""
w AS (SELECT doc_id, source, lang, {WORDS_SQL} AS ws FROM documents),
c AS (SELECT doc_id, source, lang, CAST(i AS INTEGER) AS chunk_index, ws[i * 500 + 1 : i * 500 + 500] AS part
      FROM (SELECT *, unnest(range((len(ws) + 499) // 500)) AS i FROM w))"""


@query(f"""
WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, array_to_string(part, ' ') AS chunk, CAST(len(part) AS INTEGER) AS word_count FROM c""")
def word_chunks(t):
    """Texts in chunks of 500 words."""
    return chunk_words(t.documents.select("doc_id", "text"), "text")


def corpus(t):
    """Typed corpus over all tables: reviews, set songs, guests, segues, transcripts,
    durations, lyrics and notes."""
    key = lambda c, p="gd": F.concat(F.lit(p), F.col(c).cast("string"))
    lines = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey").withColumn(SHOW, key("l_orderkey"))
    lines = lines.withColumn("position", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    lyrics = t.documents.filter("lang = 'de'").select(F.col("doc_id").alias("position"),
        F.col("source").alias("title"), F.array(F.lit("u")).alias("source_urls"), F.array("lang").alias("lyricists"), F.array().cast("array<string>").alias("music_by"),
        F.col("text").alias("lyrics_text"), F.array(F.struct(F.lit("notes").alias("source"), F.col("text"), F.lit("v").alias("url"))).alias("interpretations"))
    return U.assemble_corpus(
        U.comment_rows(t.conversations.select(key("conv_id").alias(SHOW), F.col("role").alias("reviewer"), F.col("text").alias("comment_text"),
                                              F.col("turn").cast("int").alias("rating"), F.lit("2024-01-01").alias("created"))),
        U.setlist_song_rows(lines.select(SHOW, "position", F.col("p_name").alias("song_name"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.lit("1977-05-08").alias("date"),
                                         F.lit(None).cast("string").alias("duration")), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]),
        U.guest_rows(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            key("o_orderkey").alias(SHOW), F.col("o_orderkey").alias("position"), F.col("c_name").alias("guest_artist"))),
        U.transition_rows(lines.filter("l_returnflag = 'R'").select(SHOW, "position", F.col("p_name").alias("transition_from"), F.col("p_brand").alias("transition_to"))),
        U.transcript_rows(t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("position"), F.col("source").alias("title"), key("doc_id", "u").alias("url"), F.col("text").alias("transcript"))),
        U.duration_rows(lines.filter("l_linestatus = 'F'").select(
            SHOW, "position", F.col("p_name").alias("song"), (F.col("l_quantity") * 60).alias("duration_seconds"), F.format_string("%d:00", F.col("l_quantity").cast("int")).alias("duration_display"),
            F.lit("t").alias("track_file"), F.lit(None).cast("string").alias("source"))),
        U.lyric_rows(lyrics), U.interpretation_rows(lyrics),
    )


CORPUS_SQL = f"""
{CHUNKS_SQL},
ln AS (SELECT 'gd' || l_orderkey AS sid, p_name, p_brand, l_returnflag, l_linestatus, l_quantity, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
corpus AS (
SELECT 'comment' AS type, trim(text, ' ' || chr(10)) AS text, trim(text, ' ' || chr(10)) AS comment_text, 'gd' || conv_id AS show_identifier, '' AS song_name, '' AS guest_artist, '' AS transition_from, '' AS transition_to, '' AS title FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''
UNION ALL SELECT DISTINCT 'setlist_song', p_name || ' - Grateful Dead setlist', '[Setlist] ' || p_name || ' performed at ' || sid, sid, p_name, '', '', '', '' FROM ln
UNION ALL SELECT 'guest_artist', c_name || ' played with Grateful Dead at gd' || o_orderkey, '[Guest] ' || c_name || ' performed with Grateful Dead', 'gd' || o_orderkey, '', c_name, '', '', '' FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'transition', 'Transition: ' || p_name || ' -> ' || p_brand, '[Transition] ' || p_name || ' -> ' || p_brand, sid, '', '', p_name, p_brand, '' FROM ln WHERE l_returnflag = 'R'
UNION ALL SELECT 'deadcast_transcript', array_to_string(part, ' '), '[Deadcast] ' || source || ' (chunk ' || chunk_index || ')', '', '', '', '', '', source FROM c WHERE lang = 'en'
UNION ALL SELECT 'ep_duration', p_name || ' by Grateful Dead - ' || CAST(l_quantity AS INTEGER) || ':00 at ' || sid, '[EP Duration] ' || p_name || ': ' || CAST(l_quantity AS INTEGER) || ':00 (' || CAST(l_quantity * 60 AS VARCHAR) || 's) at ' || sid, sid, p_name, '', '', '', '' FROM ln WHERE l_linestatus = 'F'
UNION ALL SELECT 'lyric', trim(text, ' ' || chr(10)), trim(text, ' ' || chr(10)), '', source, '', '', '', source FROM documents WHERE lang = 'de' AND trim(text, ' ' || chr(10)) <> ''
UNION ALL SELECT 'interpretation', trim(text, ' ' || chr(10)), trim(text, ' ' || chr(10)), '', source, '', '', '', source FROM documents WHERE lang = 'de' AND trim(text, ' ' || chr(10)) <> '')"""


@query(f"WITH {CORPUS_SQL} SELECT * FROM corpus")
def corpus_rows(t):
    """Corpus rows of every type with their texts."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return corpus(t).select("type", "text", "comment_text", blank(SHOW), *[blank(c) for c in ("song_name", "guest_artist", "transition_from", "transition_to", "title")])


@query(f"WITH {CORPUS_SQL} SELECT type, count(*) AS n FROM corpus GROUP BY 1")
def type_counts(t):
    """Corpus rows per type."""
    return metrics.type_counts(corpus(t))


@query()
def embedded_corpus(t):
    """Vectors of every text by the deterministic encoder."""
    rows = t.documents.select(F.col("doc_id").alias("row_id"), "text")
    return embed(rows, HashingEncoder(32)).select("row_id", F.size("embedding").alias("dim"),
                                                  F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


def presence(texts):
    """A vector that SQL can state too: scaled length, and whether a text holds each letter."""
    return np.array([[len(x) / 1024.0, *("e" in x, "z" in x, "ñ" in x)] for x in texts], dtype="float32")


@query("""
SELECT doc_id AS row_id, [length(text) / 1024.0::FLOAT, contains(text, 'e')::INT, contains(text, 'z')::INT, contains(text, 'ñ')::INT]::FLOAT[] AS embedding
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def refreshed_vectors(t):
    """Vectors of the rows that had none yet."""
    rows = t.documents.select(F.col("doc_id").alias("row_id"), "text")
    return refresh_vectors(rows, t.labels.select(F.col("doc_id").alias("row_id")), presence).select("row_id", "embedding")


@query("""
SELECT doc_id AS row_id, [length(text) / 1024.0::FLOAT, contains(text, 'e')::INT, contains(text, 'z')::INT, contains(text, 'ñ')::INT]::FLOAT[] AS embedding
FROM documents""")
def embedded_texts(t):
    """Vectors of every text by an encoder that SQL can follow."""
    return embed(t.documents.select(F.col("doc_id").alias("row_id"), "text"), presence).select("row_id", "embedding")


@query("SELECT vec_id AS row_id, label FROM embeddings WHERE label = 3")
def vectors_by_type(t):
    """Vectors stored by type; a typed read touches one folder."""
    path = scratch_path(t.spark, "vectors")
    write_vectors(t.embeddings.select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("type")), path)
    return t.spark.read.parquet(path).filter("type = 3").select("row_id", F.col("type").alias("label"))


# -- formatted rows -----------------------------------------------------------
def _hits(t):
    return t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("rank"), F.when(F.col("quality") == 1, "comment").when(F.col("toxic") == 1, "lyric").otherwise("setlist_song").alias("type"),
        F.when(F.col("lang") == "en", F.concat(F.lit("gd"), F.col("doc_id").cast("string"))).otherwise("").alias(SHOW), F.col("quality").alias("rating"),
        F.when(F.col("lang") != "de", F.lit("2024-01-01")).otherwise("").alias("created"), F.col("source").alias("song_name"), F.lit("7:36").alias("duration"),
        F.col("text").alias("comment_text"), (F.col("n_chars") / 8).alias("score"))


HITS = """
h AS (SELECT d.doc_id AS rank, CASE WHEN quality = 1 THEN 'comment' WHEN toxic = 1 THEN 'lyric' ELSE 'setlist_song' END AS type,
  CASE WHEN lang = 'en' THEN 'gd' || d.doc_id ELSE '' END AS sid, quality AS rating, CASE WHEN lang <> 'de' THEN '2024-01-01' ELSE '' END AS created,
  source AS song_name, text, n_chars / 8.0 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
u AS (SELECT *, CASE WHEN sid <> '' THEN 'https://archive.org/details/' || sid ELSE '' END AS url, CASE WHEN sid <> '' THEN sid ELSE song_name END AS label,
  CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS t500 FROM h)"""


@query(f"""
WITH {HITS} SELECT rank, CASE type
 WHEN 'comment' THEN '[' || rank || '] Show: ' || sid || ' ' || CASE WHEN url <> '' THEN '(' || url || ')' ELSE '' END || ' (rating: ' || rating || '/5, date: ' || created || ')' || chr(10) || 'Comment: ' || t500
 WHEN 'setlist_song' THEN '[' || rank || '] Show: ' || sid || ' ' || CASE WHEN url <> '' THEN '(' || url || ')' ELSE '' END || ' (song: ' || song_name || ' (duration: 7:36), date: ' || created || ')' || chr(10) || 'Setlist entry: ' || t500
 ELSE '[' || rank || '] ' || t500 END AS line FROM u""")
def result_lines(t):
    """Numbered result lines by row type."""
    hits = _hits(t)
    return hits.select("rank", result_line(hits).alias("line"))


@query(f"""
WITH {HITS} SELECT rank,
 '[' || rank || '] ' || label || CASE WHEN url <> '' THEN ' — ' || url ELSE '' END || CASE WHEN rating = 0 THEN '' ELSE ' (rating ' || rating || '/5)' END || CASE WHEN created <> '' THEN ' posted ' || created ELSE '' END || chr(10) || text[1:600] AS context,
 '**' || rank || '. ' || label || '**' || CASE WHEN sid <> '' THEN ' <' || url || '>' ELSE '' END || chr(10) || replace(text[1:350], chr(10), ' ') AS chat,
 '*' || rank || '* [' || CASE WHEN sid <> '' THEN sid ELSE '?' END || '](' || url || ')' || chr(10) || 'Rating: ' || rating || '/5 | Date: ' || CASE WHEN created <> '' THEN created ELSE 'N/A' END || chr(10) || text[1:400] || chr(10) AS message,
 '**#' || rank || '** · [' || sid || '](' || url || ')' || chr(10) || 'Rating: ' || rating || '/5 · ' || created || chr(10) || CASE WHEN length(text) > 400 THEN text[1:400] || '...' ELSE text END || chr(10) AS digest,
 '**#' || rank || '** — [' || CASE WHEN sid <> '' THEN sid ELSE 'N/A' END || '](' || url || ')' || chr(10) || 'Rating: ' || rating || '/5 | Date: ' || CASE WHEN created <> '' THEN created ELSE 'N/A' END || chr(10) || '_' || CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END || '_' || chr(10) AS answer,
 '**#' || rank || '** [' || sid || '](' || url || ') — Score: ' || printf('%.3f', score) || chr(10) || 'Rating: ' || rating || ' | Date: ' || created || chr(10) || '_' || text[1:500] || '..._' || chr(10) AS tool
FROM u""")
def context_lines(t):
    """Source passages and entries of every surface for each hit."""
    h = _hits(t)
    return h.select("rank", context_line(h).alias("context"), chat_line(h).alias("chat"), message_line(h).alias("message"), digest_line(h).alias("digest"),
                    answer_line(h).alias("answer"), tool_line(h).alias("tool"))


@query("""
SELECT doc_id AS rank, 'Song: ' || source || chr(10) || 'Lyricists: ' || lang || ', ' || source || ' | Music: n/a' || chr(10) || 'Sources:' || chr(10) || CASE WHEN lang = 'en' THEN '  • u' || chr(10) || '  • v' ELSE '  (no source URLs)' END || chr(10) || chr(10) || text AS card,
  chr(10) || doc_id || '. notes — http://n' || chr(10) || text[1:800] AS note FROM documents""")
def lyric_cards(t):
    """Lyrics with credits and sources, and interpretation entries."""
    rows = t.documents.select(
        F.col("doc_id").alias("rank"), F.col("source").alias("song_name"), F.array("lang", "source").alias("lyricists"), F.array().cast("array<string>").alias("music_by"),
        F.when(F.col("lang") == "en", F.array(F.lit("u"), F.lit("v"))).otherwise(F.array().cast("array<string>")).alias("source_urls"), F.col("text").alias("comment_text"),
        F.lit("notes").alias("interpretation_source"), F.lit("http://n").alias("interpretation_url"))
    return rows.select("rank", lyric_card(rows).alias("card"), note_line(rows).alias("note"))


# -- versions -----------------------------------------------------------------
NAMED = "SELECT p_name AS row_id, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey"


def _version(t, flag):
    return t.lineitem.filter(F.col("l_returnflag") == flag).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("row_id"), "l_orderkey", "l_linenumber", "l_suppkey")


@query(f"SELECT row_id, row_number() OVER (PARTITION BY row_id) AS occurrence FROM ({NAMED})")
def numbered_rows(t):
    """Equal rows told apart by the number of their occurrence."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("row_id"), "l_orderkey", "l_linenumber", "l_suppkey")
    return V.numbered(rows, ["l_orderkey", "l_linenumber", "l_suppkey"]).select("row_id", "occurrence")


VERSIONS = f"""
n AS ({NAMED}),
b AS (SELECT row_id, count(*) FILTER (WHERE l_returnflag = 'R') AS o, count(*) FILTER (WHERE l_returnflag = 'A') AS n FROM n GROUP BY 1)"""


@query(f"""
WITH {VERSIONS}
SELECT row_id, unnest(range(least(o, n) + 1, greatest(o, n) + 1)) AS occurrence, CASE WHEN n > o THEN 'added' ELSE 'removed' END AS change FROM b WHERE o <> n""")
def version_changes(t):
    """Rows that one version of a table has more or fewer than another."""
    return V.changes(_version(t, "R"), _version(t, "A"))


@query(f"WITH {VERSIONS} SELECT row_id, n FROM b WHERE n > 0")
def followed_counts(t):
    """Counts of the old version brought up to date by the changes alone."""
    old, new = _version(t, "R"), _version(t, "A")
    return V.fold_changes(V.reference_counts(old, ["row_id"]), V.changes(old, new), ["row_id"])


@query("""
SELECT doc_id AS row_id, [length(text) / 1024.0::FLOAT, contains(text, 'e')::INT, contains(text, 'z')::INT, contains(text, 'ñ')::INT]::FLOAT[] AS embedding
FROM documents""")
def followed_vectors(t):
    """Vectors that follow a table: those of rows that left go, rows that came in are embedded."""
    rows = t.documents.select(F.col("doc_id").alias("row_id"), "text")
    old = t.documents.join(t.labels.select("doc_id").hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("row_id"), "text").unionByName(
        t.conversations.select((-F.col("conv_id") - 1).alias("row_id"), "text"))  # rows that the new version does not hold
    vectors = V.one_vector(embed(old, presence))
    return V.follow_vectors(vectors, V.reference_counts(old, ["row_id"]), V.changes(old, rows), rows, presence).select("row_id", "embedding")
