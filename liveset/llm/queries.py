"""The operators of this subpackage over the given tables, each with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liveset.llm import arrowfiles, chat, collocations, decontaminate, jaccard, langid, negatives, neighbours, packing, quality, sharding, substrings, topk
from liveset.llm.common import bucket_of, scratch, written, words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; trained on those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langid.train(docs.filter(bucket_of("doc_id", 4) != 2))
    known = langid.identify(docs.select("doc_id", "text"), network)
    return known.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded into Arrow shards, read back document by document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = arrowfiles.write_tokens(docs, word_tokenizer(), scratch(spark, "tokens"), end_id=2)
    return arrowfiles.read_documents(spark, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "whole")


@query("""
WITH RECURSIVE sh AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS shard,
    ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 5, '0')), 1, 15))::BIGINT % 3301 AS off,
    ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 5, '0')), 17, 15))::BIGINT % 3300 + 1 AS step
  FROM range(32) t(i)),
f(t, owner) AS (
  SELECT 0, list_transform(range(3301), lambda x: -1)
  UNION ALL
  SELECT t + 1, list_concat(owner[:s], [t % 32], owner[s + 2:])
  FROM (
    SELECT t, owner, list_filter(list_transform(range(3301), lambda j: (off + j * step) % 3301), lambda y: owner[y + 1] = -1)[1] AS s
    FROM f JOIN sh ON sh.i = f.t % 32 WHERE t < 3301)),
o AS (SELECT unnest(range(3301)) AS slot, unnest(owner) AS i FROM f WHERE t = 3301)
SELECT doc_id, slot::INT AS slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % 3301 AS slot FROM documents) JOIN o USING (slot) JOIN sh USING (i)
""")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document by its id."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(text, '([^\x20\x09-\x0D]+)') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a AS doc_id, count(DISTINCT y.text) AS n_links FROM e JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b
      WHERE x.text <> y.text GROUP BY a)
SELECT k.doc_id, class_id, count(*) OVER (PARTITION BY text) AS n_copies, coalesce(n_links, 0) AS n_links
FROM k JOIN d USING (doc_id) LEFT JOIN l USING (doc_id)
""")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8).drop("text")


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of those that are not held out."""
    measures = written(quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    labels = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", (F.col("quality") > 0).cast("int").alias("label"))
    labelled = measures.filter(bucket_of("doc_id", 3) != 1).join(labels, "doc_id").select("stats", "label")
    scores = quality.scored(measures, quality.fit(labelled))
    return scores.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '([^\x20\x09-\x0D]+)') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(text, '([^\x20\x09-\x0D]+)') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*)::INT AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*)::INT AS n_shared, n_item
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the share they contain. Items of this
    table have five words or more, so the SQL leaves shorter ones out."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


@query(r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role || text, '<(\\*)\|(role|text|end|endoftext)\|>', '<\1\\|\2|>', 'g')) + 23 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, encoded and masked, written, and read back."""
    import public_tokenizers

    tokenizer, said = public_tokenizers.path("byte_bpe_50k.json"), r"\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    segments = written(chat.format_chats(given.union(extra), tokenizer), "chats")
    return chat.digests(segments, tokenizer)


@query("""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 10
""")
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows for every vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([^\x20\x09-\x0D]+)') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM v JOIN r USING (h)),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, j: NOT list_contains(gone, j)), ' '), '')) AS kept_sha256
FROM k
""")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the word runs that repeat elsewhere."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    digest = F.sha2(F.array_join(words_of(F.col("kept_text")), " "), 256)
    return kept.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 4,096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '([^\x20\x09]+)') AS w FROM t),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) s(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (
  SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, f, k, m, w, unnest(range(1, k - m + 2)) AS i
      FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k >= 3)),
d AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS most FROM o GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN d USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM k QUALIFY rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language whose words keep together most."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, first=2000)


@query()
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows found for every vector whose id is divisible by 100."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
    list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY rank <= 10
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every vector whose id is divisible by 100; every seventh label is moved."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved, positives=5, negatives=10)
