"""Vector, substring, name and date search."""

from __future__ import annotations

from pyspark.sql import functions as F

from liveset.functions.dates import parse_date_phrase, resolve_today
from liveset.functions.text import show_url
from liveset.operators import search as Q
from liveset.operators import vectors as V
from liveset.operators.format import build_context, extractive_answer, song_texts
from liveset.plans.answers import answer_batch
from liveset.queries import query
from liveset.queries.texts import CHUNKS_SQL, CORPUS_SQL, corpus

SHOW = "show_identifier"
TODAY = "2024-09-25"

# Questions are the mean vectors of the labels: one per label over the whole table.
CENTRES = """
x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
a AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY 1, 2),
q AS (SELECT label AS question_id, list(v ORDER BY i) AS qv FROM a GROUP BY 1),
d AS (SELECT question_id, vec_id AS row_id, label, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS score
      FROM embeddings CROSS JOIN q)"""


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("row_id"), "embedding", "label")


def _centres(t):
    return V.centroids(t.embeddings, "label").withColumnRenamed("label", "question_id")


def _shown(hits):
    return hits.withColumn("score", F.round("score", 6))


@query(f"""
WITH {CENTRES}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS rank FROM d)
SELECT question_id, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def knn_topk(t):
    """The twenty nearest vectors of every question."""
    return _shown(V.knn(_vectors(t), _centres(t), 20))


@query(f"""
WITH {CENTRES}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS rank FROM d)
SELECT question_id, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def knn_block_join(t):
    """The same by the block join that serves question batches too large to send out."""
    return _shown(V.knn(_vectors(t), _centres(t), 20, max_questions=1, grid_rows=2000))


@query(f"""
WITH {CENTRES}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS rank FROM d WHERE label IN (1, 2, 5))
SELECT question_id, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def knn_filtered(t):
    """Nearest vectors of some types only."""
    return _shown(V.knn_filtered(_vectors(t), _centres(t), 15, F.col("label").isin(1, 2, 5)))


@query(f"""
WITH {CENTRES}, r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) <= 20),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY question_id) = 1)
SELECT row_id, question_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score, row_id) AS INTEGER) AS rank FROM f ORDER BY score, row_id LIMIT 20""")
def digest_topk(t):
    """Rows near any prompt, each under the first prompt that hit it."""
    return _shown(V.digest(_vectors(t), _centres(t), 20)).select("row_id", "question_id", "score", "rank")


# -- substrings ---------------------------------------------------------------
def _song_rows(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("setlist_song").alias("type"), F.col("l_orderkey").alias(SHOW), "l_linenumber", "l_partkey", "l_suppkey", F.col("p_name").alias("song_name"))


@query("""
SELECT l_orderkey AS show_identifier, l_linenumber, l_partkey, l_suppkey, p_name AS song_name, 'https://archive.org/details/' || l_orderkey AS url
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'blue')""")
def song_search(t):
    """Every performance of songs whose name holds a term."""
    return Q.search_songs(_song_rows(t), "Blue", None).drop("type").withColumn("url", show_url(F.col(SHOW).cast("string")))


@query("""
SELECT l_orderkey AS show_identifier, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(p_name, 'ring')
ORDER BY 1, 2, 3, 4 LIMIT 20""")
def song_search_first(t):
    """The first twenty of such performances."""
    return Q.search_songs(_song_rows(t), "ring", 20, (SHOW, "l_linenumber", "l_partkey", "l_suppkey")).select(SHOW, "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_custkey AS row_id, c_name AS guest_artist FROM customer WHERE contains(lower(c_name), '00012')")
def guest_search(t):
    """Guests whose name holds a term."""
    rows = t.customer.select(F.lit("guest_artist").alias("type"), F.col("c_custkey").alias("row_id"), F.col("c_name").alias("guest_artist"))
    return Q.search_guests(rows, "00012", None).drop("type")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS transition_from, p_brand AS transition_to FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE contains(p_name, 'red') AND contains(lower(p_brand), 'brand#1')""")
def transition_search(t):
    """Segues from one song to another by parts of their names."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("transition").alias("type"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p_name").alias("transition_from"), F.col("p_brand").alias("transition_to"))
    return Q.search_transitions(rows, "Red", "Brand#1", None).drop("type")


@query("""
WITH h AS (SELECT doc_id, source, text, strpos(lower(source), 'on') AS a, strpos(lower(text), 'on') AS b FROM documents)
SELECT doc_id, source AS title, substr(text, greatest(b - 101, 0) + 1, b - 1 + 300 - greatest(b - 101, 0)) AS context, text[1:500] AS full_text FROM h WHERE b > 0 OR a > 0""")
def transcript_search(t):
    """Transcripts naming a term, with context and preview."""
    rows = t.documents.select("doc_id", F.col("source").alias("title"), F.col("text").alias("transcript"))
    return Q.search_transcripts(rows, "ON", None).drop("transcript")


@query("""
WITH terms AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS term FROM part)
SELECT doc_id, term AS question_id FROM documents JOIN terms ON contains(lower(text), term)""")
def term_hits(t):
    """Texts holding any of a batch of terms."""
    terms = t.part.select(F.lower(F.get(F.split("p_name", " "), F.lit(0))).alias("term")).distinct()
    return Q.substring_hits(t.documents.select("doc_id", "text"), terms.withColumn("question_id", F.col("term")), "text").select("doc_id", "question_id")


@query("""
WITH names AS (SELECT DISTINCT c_name FROM customer), terms AS (SELECT DISTINCT s_name, replace(s_name, 'Supplier#0000', '') AS term FROM supplier)
SELECT c_name, s_name AS question_id FROM names JOIN terms ON contains(lower(c_name), term)""")
def term_hits_many(t):
    """The same for more terms than fit a literal: texts and terms meet on character runs."""
    terms = t.supplier.select(F.col("s_name").alias("question_id"), F.replace("s_name", F.lit("Supplier#0000"), F.lit("")).alias("term")).distinct()
    return Q.substring_hits(t.customer.select("c_name").distinct(), terms, "c_name", max_terms=0, max_bytes=0).select("c_name", "question_id")


# -- names --------------------------------------------------------------------
QUESTIONS = ["Red Widget", "ring", "a hot blue thing", "old", "bolt gear hot", "China Cat"]


def _phrases(t, phrases):
    return t.spark.createDataFrame(list(enumerate(phrases)), "question_id int, question string")


def _values(phrases):
    return ", ".join(f"({i}, '{p}')" for i, p in enumerate(phrases))


SCORES = f"""
q AS (SELECT qid AS question_id, lower(p) AS q FROM (VALUES {_values(QUESTIONS)}) v(qid, p)),
n AS (SELECT DISTINCT p_name AS song_name FROM part),
s AS (SELECT question_id, song_name, CASE WHEN song_name = q THEN 1.0 WHEN contains(song_name, q) OR contains(q, song_name) THEN 0.8
   ELSE 0.5 * len(list_intersect(string_split(q, ' '), string_split(song_name, ' '))) / greatest(len(list_distinct(string_split(q, ' '))), len(string_split(song_name, ' '))) END AS score FROM q CROSS JOIN n)"""


@query(f"WITH {SCORES} SELECT question_id, song_name, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score > 0")
def lyric_scores(t):
    """Score of every song name against every question."""
    scored = Q.lyric_scores(t.part.select(F.col("p_name").alias("song_name")), _phrases(t, QUESTIONS))
    return scored.withColumn("score", F.round("score", 6))


@query(f"""
WITH {SCORES}, r AS (SELECT question_id, p_partkey AS row_id, score FROM s JOIN part ON p_name = song_name WHERE score > 0 AND p_size <> 7),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_id) AS rank FROM r)
SELECT question_id, row_id, round(CAST(1 - (rank - 1) * 0.001 AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 15""")
def lyric_search(t):
    """The best lyric and note rows per question by song name."""
    rows = t.part.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_size") != 7, "lyric").otherwise("comment").alias("type"), F.col("p_name").alias("song_name"))
    return _shown(Q.search_lyrics(rows, _phrases(t, QUESTIONS), 15))


# -- dates --------------------------------------------------------------------
DATE_QUESTIONS = ["shows on Sep 25", "9/25", "1997-09-25", "September twenty-fifth", "best of today", "5-8", "what about march third, 1998", "best jam ever"]
DATED = """
q AS (SELECT * FROM (VALUES (0, 9, 25, NULL), (1, 9, 25, NULL), (2, 9, 25, 1997), (3, 9, 25, NULL), (4, 9, 25, 2024), (5, 5, 8, NULL), (6, 3, 3, 1998)) v(question_id, m, d, y)),
hit AS (SELECT question_id, o_orderkey AS row_id FROM orders JOIN q ON month(o_orderdate) = m AND day(o_orderdate) = d AND (y IS NULL OR y = year(o_orderdate)))"""


def _dated(t):
    return t.orders.select(F.col("o_orderkey").alias("row_id"), F.lit("setlist_song").alias("type"),
                           F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("gd"), F.date_format("o_orderdate", "yy-MM-dd"), F.lit(".aud"))).otherwise("misc").alias(SHOW),
                           F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(f"WITH {DATED} SELECT question_id, row_id, CAST(1.0 AS DOUBLE) AS score FROM hit")
def date_search(t):
    """Rows of shows on the dates that questions name."""
    return Q.search_by_date(_dated(t), _phrases(t, DATE_QUESTIONS), F.to_date(F.lit(TODAY)))


@query("""
SELECT o_orderkey, CAST(NULL AS INTEGER) AS y1, CAST(month(o_orderdate) AS INTEGER) AS m1, CAST(day(o_orderdate) AS INTEGER) AS d1, CAST(year(o_orderdate) AS INTEGER) AS y2,
  'what happened on ' || strftime(o_orderdate, '%B %d, %Y') || '?' AS resolved FROM orders""")
def date_phrases(t):
    """Dates read from phrases, and the word today written out."""
    day = F.to_date("o_orderdate")
    read = t.orders.select(
        "o_orderkey", parse_date_phrase(F.date_format(day, "'shows on' MMMM d"), day).alias("a"),
        parse_date_phrase(F.date_format(day, "'on' MMM d, yyyy"), day).alias("b"),
        resolve_today(F.lit("what happened on Today?"), day).alias("resolved"))
    return read.select("o_orderkey", F.col("a.year").alias("y1"), F.col("a.month").alias("m1"), F.col("a.day").alias("d1"),
                       F.col("b.year").alias("y2"), "resolved")


# -- combined -----------------------------------------------------------------
@query(f"""
WITH {CENTRES},
near AS (SELECT question_id, row_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS place FROM d QUALIFY place <= 12),
dated AS (SELECT question_id, vec_id AS row_id FROM q JOIN embeddings ON true JOIN orders ON vec_id = o_orderkey WHERE month(o_orderdate) = question_id + 1 AND day(o_orderdate) = 2),
u AS (SELECT question_id, row_id, score, 'distance' AS score_kind, 0 AS part, place FROM near
  UNION ALL SELECT question_id, row_id, 1.0, 'date', 1, 0 FROM dated WHERE (question_id, row_id) NOT IN (SELECT (question_id, row_id) FROM near))
SELECT question_id, row_id, round(score, 6) AS score, score_kind, row_number() OVER (PARTITION BY question_id ORDER BY part, place, row_id) AS rank FROM u""")
def hybrid_search(t):
    """Nearest rows, then rows of the date a question names, each row once."""
    shows = t.orders.select(F.col("o_orderkey").alias("row_id"), F.date_format("o_orderdate", "'gd'yyyy-MM-dd").alias(SHOW))
    rows = _vectors(t).join(shows, "row_id", "left").select("row_id", "embedding", SHOW, F.lit("comment").alias("type"), F.lit("").alias("created"))
    asked = _centres(t).withColumn("question", F.concat((F.col("question_id") + 1).cast("string"), F.lit("/2")))
    return _shown(Q.hybrid_search(rows, asked, 12, F.to_date(F.lit(TODAY))))


@query(f"""
WITH {CENTRES}, r AS (SELECT question_id, row_id, label, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS rank FROM d QUALIFY rank <= 30),
e AS (SELECT question_id, row_id, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS rank FROM d WHERE label IN (1, 2, 5) QUALIFY rank <= 15)
SELECT question_id, row_id FROM r WHERE (question_id, row_id) NOT IN (SELECT (question_id, row_id) FROM e)""")
def later_hits(t):
    """Hits that an earlier result list does not hold yet."""
    centres = _centres(t)
    earlier = V.knn_filtered(_vectors(t), centres, 15, F.col("label").isin(1, 2, 5))
    return Q.without_earlier(V.knn(_vectors(t), centres, 30), earlier).select("question_id", "row_id")


ROUTED = ['song:"Red Widget"', 'guest:"customer#000000012"', "transition:blue -> brand#1", 'deadcast:"the"', "ep:", "plain question"]


@query(f"""
WITH {CORPUS_SQL},
h AS (SELECT 0 AS question_id, 'song' AS route, type, comment_text FROM corpus WHERE type = 'setlist_song' AND contains(lower(song_name), 'red widget')
 UNION ALL SELECT 1, 'guest', type, comment_text FROM corpus WHERE type = 'guest_artist' AND contains(lower(guest_artist), 'customer#000000012')
 UNION ALL SELECT 2, 'transition', type, comment_text FROM corpus WHERE type = 'transition' AND contains(lower(transition_from), 'blue') AND contains(lower(transition_to), 'brand#1')
 UNION ALL SELECT 3, 'deadcast', type, comment_text FROM corpus WHERE type = 'deadcast_transcript' AND contains(lower(text), 'the'))
SELECT question_id, route, count(*) AS n, count(DISTINCT comment_text) AS texts FROM h GROUP BY 1, 2""")
def answer_batch_counts(t):
    """Hits per question of a batch, each question by its own route."""
    rows = corpus(t)
    # Row ids are hashes of what rows say, so counting needs every hit, not the first k.
    many = {r: 10 ** 9 for r in ("song", "guest", "transition", "deadcast")}
    hits = answer_batch(rows, _phrases(t, ROUTED), limits=many, keep=["comment_text"]).filter("route <> 'ep'")
    return hits.groupBy("question_id", "route").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("comment_text").alias("texts"))


@query(f"""
WITH {CENTRES}, r AS (SELECT question_id, row_id, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS rank FROM d QUALIFY rank <= 10),
l AS (SELECT question_id, rank, '[' || rank || '] gd' || source || ' — https://archive.org/details/gd' || source || chr(10) || text[1:600] AS line FROM r JOIN documents ON row_id = doc_id)
SELECT question_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS text, CAST(count(*) AS INTEGER) AS n_sources FROM l GROUP BY 1""")
def question_contexts(t):
    """Source passages of the nearest rows as one text per question."""
    hits = V.knn(_vectors(t), _centres(t), 10)
    texts = t.documents.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("gd"), "source").alias(SHOW), F.col("text").alias("comment_text"), F.lit("comment").alias("type"))
    return build_context(hits.join(texts, "row_id"), k=10)


# -- all routes with ranks ----------------------------------------------------
ORDER = ("section", "position", "chunk_index", "comment_text", SHOW, "row_id")


@query(f"""
WITH {CENTRES},
ln AS (SELECT 'gd' || l_orderkey AS sid, l_orderkey * 100 + l_linenumber AS pos, p_name, p_brand, l_returnflag, l_linestatus, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
{CHUNKS_SQL.strip()},
h AS (
  SELECT 0 AS question_id, 'song' AS route, '[Setlist] ' || p_name || ' performed at ' || sid AS comment_text, min(pos) AS pos, 0 AS chunk, sid FROM ln WHERE contains(p_name, 'red widget') GROUP BY sid, p_name
  UNION ALL SELECT 1, 'guest', '[Guest] ' || c_name || ' performed with Grateful Dead', o_orderkey, 0, 'gd' || o_orderkey
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), 'customer#00000001')
  UNION ALL SELECT 2, 'transition', '[Transition] ' || p_name || ' -> ' || p_brand, pos, 0, sid FROM ln
    WHERE l_returnflag = 'R' AND contains(p_name, 'blue') AND contains(lower(p_brand), 'brand#1')
  UNION ALL SELECT 3, 'deadcast', '[Deadcast] ' || source || ' (chunk ' || chunk_index || ')', doc_id, chunk_index, '' FROM c
    WHERE lang = 'en' AND contains(lower(array_to_string(part, ' ')), 'the')),
lists AS (SELECT question_id, route, comment_text, row_number() OVER (PARTITION BY question_id ORDER BY pos, chunk, comment_text, sid) AS rank,
  count(*) OVER (PARTITION BY question_id) AS total FROM h),
ep AS (SELECT '[EP Duration] ' || p_name || ': ' || CAST(l_quantity AS INTEGER) || ':00 (' || CAST(l_quantity * 60 AS VARCHAR) || 's) at ' || sid AS comment_text, l_quantity, pos, sid FROM ln WHERE l_linestatus = 'F'),
near AS (SELECT 'vector ' || vec_id AS comment_text, row_number() OVER (ORDER BY score, 'v' || vec_id) AS rank
  FROM (SELECT row_id AS vec_id, score FROM d WHERE question_id = 3))
SELECT question_id, route, comment_text, CAST(rank AS INTEGER) AS rank, total FROM lists WHERE rank <= CASE route WHEN 'song' THEN 20 ELSE 10 END
UNION ALL SELECT 4, 'ep', comment_text, CAST(row_number() OVER (ORDER BY l_quantity DESC, pos, comment_text, sid) AS INTEGER) AS rank, NULL FROM ep QUALIFY rank <= 20
UNION ALL SELECT 5, 'vector', comment_text, CAST(rank AS INTEGER), NULL FROM near WHERE rank <= 20""")
def answer_batch_ranked(t):
    """All six routes of a question batch: the first rows in corpus order, and how many there are."""
    vectors = t.embeddings.select(F.lit("book_chunk").alias("type"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("row_id"),
                                  F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("comment_text"), "embedding")
    rows = corpus(t).unionByName(vectors, allowMissingColumns=True)  # never stored: every route makes rows of its own types only
    asked = ['song:"Red Widget"', 'guest:"customer#00000001"', "transition:blue -> brand#1", 'deadcast:"the"', "ep:", "plain question"]
    fourth = _centres(t).filter("question_id = 3").select(F.lit(5).alias("question_id"), "embedding")
    questions = _phrases(t, asked).join(fourth, "question_id", "left")
    return answer_batch(rows, questions, order=ORDER, keep=["comment_text"]).select("question_id", "route", "comment_text", F.col("rank").cast("int").alias("rank"), "total")


@query("""
WITH terms AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM benchmark)
SELECT term AS question_id, doc_id, count(*) OVER (PARTITION BY term) AS total,
  CAST(row_number() OVER (PARTITION BY term ORDER BY doc_id) AS INTEGER) AS rank
FROM documents JOIN terms ON contains(lower(text), term) WHERE length(term) > 3 QUALIFY rank <= 5""")
def term_scan(t):
    """Every longer word of the benchmark looked for in all texts at once: the first five texts
    of each, and how many there are."""
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter(F.length("term") > 3).distinct()
    texts = t.documents.select("doc_id", "text")
    hits = Q.substring_hits(texts, words.withColumn("question_id", F.col("term")), "text", keep=["doc_id"])
    return Q.first_with_total(hits, ["question_id"], [("doc_id", "ascending")], 5).select("question_id", "doc_id", "total", "rank")


SONG_QUESTIONS = [f"src{i}" for i in range(6)] + ["no such song"]


@query(f"""
WITH q AS (SELECT qid AS question_id, p FROM (VALUES {_values(SONG_QUESTIONS)}) v(qid, p)),
d AS (SELECT doc_id, doc_id % 3 = 0 AS is_lyric, source, lang, trim(text, ' ' || chr(10)) AS t FROM documents WHERE trim(text, ' ' || chr(10)) <> ''),
h AS (SELECT question_id, d.*, row_number() OVER (PARTITION BY question_id ORDER BY source <> p, doc_id) AS rank
  FROM q JOIN d ON contains(source, p) OR contains(p, source) QUALIFY rank <= 15),
f AS (SELECT question_id, arg_min(chr(10) || 'Song: ' || source || chr(10) || 'Lyricists: ' || lang || ' | Music: n/a' || chr(10) || 'Sources:' || chr(10) || '  • u' || doc_id || chr(10) || chr(10) || t, rank) AS card,
        arg_min(chr(10) || 'Song: ' || source || chr(10) || 'Sources:' || chr(10) || '  • u' || doc_id || chr(10) || chr(10) || t, rank) AS plain FROM h WHERE is_lyric GROUP BY 1),
n AS (SELECT question_id, string_agg(chr(10) || k || '. notes — v' || doc_id || chr(10) || t[1:800], chr(10) ORDER BY k) AS notes
      FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM h WHERE NOT is_lyric) GROUP BY 1)
SELECT question_id,
  CASE WHEN card IS NULL THEN 'No lyrics found matching "' || p || '". Try meaning "song name".'
    ELSE 'LYRICS — ' || p || chr(10) || card || chr(10) || chr(10) || chr(10) || 'Tip: use meaning "song name" for lyrics + interpretations.' END AS lyrics,
  CASE WHEN card IS NULL AND notes IS NULL THEN 'No lyrics or interpretations found matching "' || p || '".'
    ELSE 'MEANING — ' || p || chr(10) || coalesce(plain, '') || coalesce(chr(10) || chr(10) || chr(10) || 'INTERPRETATIONS' || chr(10) || notes, '') END AS meaning
FROM q LEFT JOIN f USING (question_id) LEFT JOIN n USING (question_id)""")
def song_answer_texts(t):
    """Lyric and meaning texts per question, with heading, card, interpretations and closing line."""
    rows = t.documents.select(
        F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 3 == 0, "lyric").otherwise("interpretation").alias("type"), F.col("source").alias("song_name"),
        F.array(F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("source_urls"), F.array("lang").alias("lyricists"),
        F.array().cast("array<string>").alias("music_by"), F.lit("notes").alias("interpretation_source"),
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("interpretation_url"), F.expr("trim(BOTH ' \n' FROM text)").alias("comment_text")).filter("comment_text != ''")
    asked = _phrases(t, SONG_QUESTIONS)
    hits = Q.search_lyrics(rows, asked, 15).select("question_id", "row_id", "rank").join(rows, "row_id")
    return song_texts(asked, hits, 15)


@query(f"""
WITH {CENTRES},
near AS (SELECT question_id, row_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS place FROM d QUALIFY place <= 8),
dated AS (SELECT question_id, vec_id AS row_id FROM q JOIN embeddings ON true JOIN orders ON vec_id = o_orderkey WHERE month(o_orderdate) = question_id + 1 AND day(o_orderdate) = 2),
named AS (SELECT question_id, vec_id AS row_id, 1 - (row_number() OVER (PARTITION BY question_id ORDER BY vec_id) - 1) * 0.001 AS score,
  row_number() OVER (PARTITION BY question_id ORDER BY vec_id) AS place FROM q JOIN embeddings ON label = question_id QUALIFY place <= 5),
u AS (SELECT question_id, row_id, score, 'distance' AS score_kind, 0 AS part, place FROM near
  UNION ALL SELECT question_id, row_id, 1.0, 'date', 1, 0 FROM dated
  UNION ALL SELECT question_id, row_id, score, 'lexical', 2, place FROM named),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY question_id, row_id ORDER BY part) = 1)
SELECT question_id, row_id, round(CAST(score AS DOUBLE), 6) AS score, score_kind, row_number() OVER (PARTITION BY question_id ORDER BY part, place, row_id) AS rank FROM o""")
def three_list_search(t):
    """Nearest rows, rows of the named date and rows of the named song in one list, in that order."""
    shows = t.orders.select(F.col("o_orderkey").alias("row_id"), F.date_format("o_orderdate", "'gd'yyyy-MM-dd").alias(SHOW))
    rows = t.embeddings.select(F.col("vec_id").alias("row_id"), "embedding", F.concat(F.lit("tune "), F.col("label").cast("string")).alias("song_name")).join(
        shows, "row_id", "left").select("row_id", "embedding", "song_name", SHOW, F.lit("lyric").alias("type"), F.lit("").alias("created"))
    number = F.col("question_id").cast("string")
    asked = _centres(t).withColumn("question", F.concat((F.col("question_id") + 1).cast("string"), F.lit("/2")))
    dated, named = asked, asked.withColumn("question", F.concat(F.lit("tune "), number))
    lists = Q.combine_hits(
        ("distance", V.knn(rows, asked, 8)), ("date", Q.search_by_date(rows, dated, F.to_date(F.lit(TODAY)))),
        ("lexical", Q.search_lyrics(rows, named.drop("embedding"), 5)))
    return _shown(lists)


@query(f"""
WITH {CENTRES}, r AS (SELECT question_id, row_id, row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS rank FROM d QUALIFY rank <= 10),
l AS (SELECT question_id, rank, '**#' || rank || '** — [gd' || source || '](https://archive.org/details/gd' || source || ')' || chr(10) || 'Rating: N/A/5 | Date: N/A' || chr(10)
  || '_' || CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END || '_' || chr(10) AS line FROM r JOIN documents ON row_id = doc_id)
SELECT question_id, 'Based on ' || count(*) || ' sources:' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS text, CAST(count(*) AS INTEGER) AS n_sources FROM l GROUP BY 1""")
def extractive_answers(t):
    """Answers made of the nearest rows themselves."""
    hits = V.knn(_vectors(t), _centres(t), 10)
    texts = t.documents.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("gd"), "source").alias(SHOW), F.col("text").alias("comment_text"), F.lit("comment").alias("type"))
    return extractive_answer(hits.join(texts, "row_id"), k=10)
