"""Song catalogue, posts, review queue, pages and link graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.text import clean_html, clean_html_line, clean_song_title, song_key
from liveset.functions.urls import canonical_url
from liveset.operators import catalog as C
from liveset.operators import forum
from liveset.operators import graph as G
from liveset.operators import metrics
from liveset.operators import pages as P
from liveset.operators import review as R
from liveset.operators.chunks import split_text as split_rows
from liveset.queries import query
from liveset.scale import scratch_path
from liveset.sources.readers import read_graph_csv
from liveset.sources.sinks import write_graph_csv

SHOW = "show_identifier"


def _song_lines(t):
    return t.lineitem.select("l_orderkey", "l_partkey").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")


def _noisy_name():
    return F.concat(F.lit("d1t02 - "), "p_name", F.lit(" [7:52] ->"))


# -- catalogue ----------------------------------------------------------------
@query("""
SELECT p_name AS name, count(*) AS setlist_mentions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def song_mentions(t):
    """Mentions per cleaned song name."""
    return C.song_mentions(_song_lines(t).withColumn("song_name", _noisy_name()))


@query("""
SELECT replace(p_name, ' ', '-') AS slug, p_name AS name, count(l_partkey) AS setlist_mentions
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2
UNION ALL SELECT 'never-played-' || lower(r_name), 'Never Played ' || upper(r_name[1]) || array_to_string(list_transform(string_split(lower(r_name[2:]), ' '), lambda x: x), ' '), 0
FROM region WHERE r_name NOT LIKE '% %'""")
def canonical_mentions(t):
    """Mentions per catalogue song; songs never mentioned keep a title made of their slug."""
    slugs = t.part.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), song_key("p_name", None).alias("song_key")).distinct()
    unplayed = t.region.filter("r_name not like '% %'").select(
        F.concat(F.lit("never-played-"), F.lower("r_name")).alias("slug"), F.concat(F.lit("never played "), F.lower("r_name")).alias("song_key"))
    index = slugs.unionByName(unplayed)
    mentions = C.song_mentions(_song_lines(t).withColumnRenamed("p_name", "song_name"), decode=None)
    return C.canonical_mentions(C.match_canonical(mentions, index, decode=None), index)


@query(name="fuzzy_names")
def fuzzy_names(t):
    """Close matches of misspelt catalogue names."""
    misspelt = F.concat(F.regexp_replace("p_name", "([aeiou])", "$1$1"), F.lit(" the band "), F.lower("p_type"))
    right = t.part.select(F.concat("p_name", F.lit(" the band "), F.lower("p_type")).alias("right_key")).distinct()
    return C.fuzzy_match(t.part.select(misspelt.alias("left_key")), right, 0.9)


@query(r"""
SELECT p_partkey, 'me and my ' || p_name AS key, upper(p_name) AS title, regexp_matches('Jerry ' || p_name || ' - Guitar', 'a^') OR length(p_name || p_name || repeat('x', p_size)) > 60 AS noise
FROM part""")
def song_name_forms(t):
    """Matching key, cleaned title and noise flag of song names."""
    from liveset.functions.text import is_song_noise
    raw = F.concat(F.lit("E: Me & My the "), F.upper("p_name"))
    return t.part.select("p_partkey", song_key(raw).alias("key"), clean_song_title(F.concat(F.lit("08 "), F.upper("p_name"), F.lit(" -> (note 3)"))).alias("title"),
                         is_song_noise(F.concat("p_name", "p_name", F.expr("repeat('x', p_size)"))).alias("noise"))


@query("""
WITH s AS (SELECT DISTINCT p_name, CASE WHEN p_name LIKE 'red%' THEN p_name END AS a, CASE WHEN p_name LIKE '%ring' THEN p_name END AS b FROM part)
SELECT count(*) AS corpus_songs, count(a) AS matched_a, count(*) - count(a) AS unmatched_a, count(b) AS matched_b, count(*) - count(b) AS unmatched_b FROM s""")
def coverage(t):
    """Catalogue songs matched and unmatched per source."""
    songs = t.part.select("p_name").distinct().select(
        F.when(F.col("p_name").startswith("red"), F.col("p_name")).alias("a"), F.when(F.col("p_name").endswith("ring"), F.col("p_name")).alias("b"))
    return C.match_coverage(songs, ["a", "b"])


@query("""
WITH m AS (SELECT DISTINCT p_type AS source, p_name AS song FROM part WHERE p_size > 25),
f AS (SELECT source, song FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY song) <= 5)
SELECT source, (SELECT count(*) FROM m WHERE m.source = f.source) AS misses, string_agg(song, '|' ORDER BY song) AS sample FROM f GROUP BY source""")
def misses_per_source(t):
    """Misses per source with a few names."""
    misses = t.part.filter("p_size > 25").select(F.col("p_type").alias("source"), F.col("p_name").alias("song")).distinct()
    return C.misses_per_source(misses).withColumn("sample", F.array_join("sample", "|"))


@query("""
WITH c AS (SELECT p_name AS name, count(*) AS setlist_mentions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
done AS (SELECT p_name AS name FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_brand = 'Brand#4' GROUP BY 1 HAVING count(DISTINCT p_type) = 2)
SELECT name, setlist_mentions FROM c WHERE name NOT IN (SELECT name FROM done) ORDER BY setlist_mentions DESC, name LIMIT 20""")
def next_songs(t):
    """The most mentioned songs with a source left to look up."""
    corpus = _song_lines(t).groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("setlist_mentions"))
    done = t.part.filter("p_brand = 'Brand#4'").select(F.col("p_name").alias("name"), F.col("p_type").alias("source"))
    return C.next_songs(corpus, done, ["ECONOMY", "SMALL"], 20)


@query("""
WITH s AS (SELECT DISTINCT p_name AS song_name FROM part),
p AS (SELECT p_partkey, p_name || ' at ' || p_type AS title, p_brand AS body FROM part)
SELECT song_name, CAST(row_number() OVER (PARTITION BY song_name ORDER BY p_partkey) AS INTEGER) AS rank, 'reddit' AS source,
  'Discussion: ' || title || ' -- ' || body AS text, 'u' || p_partkey AS url, '2024' AS date
FROM s JOIN p ON contains(' ' || lower(title) || ' ', ' ' || song_name || ' ')
QUALIFY row_number() OVER (PARTITION BY song_name ORDER BY p_partkey) <= 5""")
def posts_for_songs(t):
    """First five posts naming each song."""
    posts = t.part.select("p_partkey", F.concat(F.lit("Discussion: "), "p_name", F.lit(" at "), "p_type").alias("title"),
                          F.concat(F.lit(" "), "p_brand").alias("text"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.lit("2024").alias("created"))
    return C.posts_for_songs(t.part.select(F.col("p_name").alias("song_name")).distinct(), posts, ["p_partkey"])


def _entries(t):
    note = F.struct(F.lit("notes").alias("source"), F.col("source").alias("text"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("date"))
    return t.documents.select(
        F.col("lang").alias("song"), F.col("doc_id").alias("priority"), F.col("source").alias("title"), F.concat(F.lit("http://x/"), "source").alias("url"),
        F.array("source", F.lit("")).alias("lyricists"), F.array(F.lit("band")).alias("music_by"), F.col("text").alias("lyrics_text"),
        F.array(note, note).alias("interpretations"), F.when(F.col("n_chars") > 1000, F.col("source")).alias("first_played_hint"))


@query("""
SELECT lang AS song, arg_min(source, doc_id) AS title, arg_max(text, (length(text), -doc_id)) AS lyrics_text,
  arg_min(source, doc_id) FILTER (WHERE n_chars > 1000) AS first_played_hint FROM documents GROUP BY lang""")
def merge_entries(t):
    """Entries of a song merged over sources: first title, longest text."""
    return C.merge_song_entries(_entries(t))["songs"]


@query("""
SELECT lang AS song, 'lyricist' AS kind, source AS credit, min(doc_id) AS first_at FROM documents GROUP BY lang, source
UNION ALL SELECT lang, 'music', 'band', min(doc_id) FROM documents GROUP BY lang""")
def merge_entry_credits(t):
    """Distinct credits of merged entries with their first source."""
    return C.merge_song_entries(_entries(t))["credits"].withColumn("first_at", F.col("first_at.priority"))


@query("""
SELECT lang AS song, 'notes' AS source, source AS text, min(doc_id) AS first_at, 'u' AS interpretation_url FROM documents GROUP BY lang, source""")
def merge_entry_notes(t):
    """Distinct interpretations of merged entries."""
    return C.merge_song_entries(_entries(t))["interpretations"].drop("date").withColumn("first_at", F.col("first_at.priority"))


@query("""
SELECT DISTINCT p_name AS song, 'pending-deadnet-browser-fetch' AS hook FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 50)
UNION ALL SELECT DISTINCT p_name, 'pending-reddit-fetch (HTTP 403)' FROM part""")
def pending_sources(t):
    """Sources still to look up per song."""
    notes = t.part.filter("p_size = 50").select(F.col("p_name").alias("song"), F.lit(fixed.SOURCE_FIELDS).alias("source"))
    return C.pending_sources(t.part.select(F.col("p_name").alias("song")), notes, forum_blocked=True)


# -- posts and messages -------------------------------------------------------
@query(r"""
WITH d AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS t, lower(text) AS b, source FROM documents),
l AS (SELECT doc_id, list_filter([
   CASE WHEN regexp_matches(b, 'setlist|set list|what did they play') THEN 'setlist' END,
   CASE WHEN regexp_matches(b, 'review|thoughts|discussion') THEN 'review' END,
   CASE WHEN source = 'src1' THEN 'show_thread' END,
   CASE WHEN regexp_matches(b, 'song|track|favorite') THEN 'song' END], lambda x: x IS NOT NULL) AS c FROM d)
SELECT doc_id, CASE WHEN len(c) > 0 THEN array_to_string(c, ',') ELSE 'general' END AS categories FROM l""")
def classify_posts(t):
    """Labels of posts by title and body."""
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    posts = t.documents.select("doc_id", F.when(F.col("source") == "src1", F.concat(first_line, F.lit(" 1977-05-08"))).otherwise(first_line).alias("title"),
                               F.col("text").alias("selftext"))
    return forum.classify_posts(posts).select("doc_id", F.array_join("categories", ",").alias("categories"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'GD' || strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
  ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS show_date FROM orders""")
def title_dates(t):
    """Date as written in a title."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("GD"), iso, F.lit("x"))).when(F.col("o_orderstatus") == "O", iso).otherwise(
        F.date_format("o_orderdate", "M/d/yyyy"))
    posts = t.orders.select("o_orderkey", F.concat(F.lit("Show of "), text, F.lit(" tonight")).alias("title"))
    return forum.with_show_date(posts).select("o_orderkey", "show_date")


@query("""
WITH c AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, turn, 0 AS comment_no, text[1:2000] AS body, 'a' AS author, 0 AS depth FROM c
UNION ALL SELECT conv_id, turn, 1, 'reply', '[deleted]', 1 FROM c UNION ALL SELECT conv_id, turn, 2, 'deep', '[deleted]', 2 FROM c
UNION ALL SELECT conv_id, turn, 3, 'second', 'b', 0 FROM c""")
def flatten_replies(t):
    """Comment trees as rows in reading order."""
    def node(**data):
        fields = {"id": F.lit("i"), "body": F.lit(""), "author": F.lit(None).cast("string"), "score": F.lit(1),
                  "created_utc": F.lit(0.0), "replies": F.lit(""), **data}
        return F.struct(F.lit("t1").alias("kind"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("data"))

    def listing(child):
        return F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data")))

    deep = listing(node(body=F.lit("deep")))
    tree = F.array(node(body=F.col("text"), author=F.lit("a"), replies=listing(node(body=F.lit("reply"), replies=deep))), node(body=F.lit("second"), author=F.lit("b")))
    posts = t.conversations.select("conv_id", "turn", tree.alias("comments"))
    return forum.flatten_replies(posts, cap_rows=fixed.REPLY_CAP, body_cap=fixed.REPLY_BODY_CAP).select("conv_id", "turn", "comment_no", "body", "author", "depth")


@query(r"""
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'search' WHEN 'system' THEN 'lyrics' ELSE 'ask' END AS action, trim(text) AS question FROM conversations""")
def parse_messages(t):
    """Action and question of messages."""
    said = F.when(F.col("role") == "user", F.concat(F.lit("!gd Search \""), F.trim("text"), F.lit('"'))).when(
        F.col("role") == "system", F.concat(F.lit("lyrics "), F.col("text"))).otherwise(F.concat(F.lit("!GD "), F.col("text")))
    return forum.parse_messages(t.conversations.select("conv_id", "turn", said.alias("text"))).drop("text")


@query("""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'song' WHEN 'SMALL' THEN 'transition' WHEN 'STANDARD' THEN 'ep' ELSE 'vector' END AS route,
  CASE p_type WHEN 'STANDARD' THEN '' ELSE p_name END AS arg1, CASE p_type WHEN 'SMALL' THEN p_brand END AS arg2 FROM part""")
def route_questions(t):
    """Route and arguments of prefixed questions."""
    q = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit('song:"'), "p_name", F.lit('"')))
         .when(F.col("p_type") == "SMALL", F.concat(F.lit("transition:"), "p_name", F.lit(" -> "), "p_brand"))
         .when(F.col("p_type") == "STANDARD", F.lit("ep:")).otherwise(F.col("p_name")))
    return forum.route_questions(t.part.select("p_partkey", q.alias("question"))).drop("question")


@query("""
WITH RECURSIVE cut AS (
  SELECT doc_id, -1 AS part_no, text AS rest, CAST(NULL AS VARCHAR) AS part FROM documents
  UNION ALL
  SELECT doc_id, part_no + 1,
    CASE WHEN length(rest) > 2000 THEN ltrim(substr(rest, c + 1), chr(10)) ELSE NULL END,
    CASE WHEN length(rest) > 2000 THEN substr(rest, 1, c) ELSE rest END
  FROM (SELECT *, CASE WHEN contains(substr(rest, 1, 2000), chr(10)) AND 2000 - strpos(reverse(substr(rest, 1, 2000)), chr(10)) >= 1000
                       THEN 2000 - strpos(reverse(substr(rest, 1, 2000)), chr(10)) ELSE 2000 END AS c FROM cut) WHERE rest IS NOT NULL AND rest <> '')
SELECT doc_id, CAST(part_no AS INTEGER) AS part_no, part FROM cut WHERE part_no >= 0""")
def split_text(t):
    """Long texts in parts of at most 2000 characters, cut at newlines where they fall late enough."""
    return split_rows(t.documents.select("doc_id", "text"), "text", 2000)


# -- review queue -------------------------------------------------------------
def _queue(t):
    staging = t.documents.select(F.col("doc_id").alias("song_name"), F.when(F.col("lang") == "de", "rejected").when(F.col("lang") == "fr", "odd").alias("status"))
    decisions = t.labels.select(F.col("doc_id").alias("song_name"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("status"))
    return R.review_queue(staging, decisions)


QUEUE = """
q AS (SELECT d.doc_id AS song_name, coalesce(CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' END,
       CASE lang WHEN 'de' THEN 'rejected' WHEN 'fr' THEN 'odd' END, 'pending') AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(f"""
WITH {QUEUE} SELECT song_name, status, CASE status WHEN 'approved' THEN 1 WHEN 'rejected' THEN 2 ELSE 0 END AS status_rank FROM q""")
def review_queue(t):
    """Staged rows under their decisions, with their queue rank."""
    return _queue(t)


@query(f"""WITH {QUEUE} SELECT song_name, row_number() OVER (ORDER BY song_name) AS place,
   CAST(ceil(row_number() OVER (ORDER BY song_name) / 10.0) AS INTEGER) AS page FROM q WHERE status = 'pending'""")
def review_pages(t):
    """Pending rows with their page numbers."""
    return R.numbered_pages(_queue(t), ["song_name"]).select("song_name", "place", "page")


@query(f"WITH {QUEUE} SELECT song_name FROM q WHERE status = 'pending' ORDER BY song_name LIMIT 10 OFFSET 10")
def review_page(t):
    """Second page of pending rows."""
    return R.review_page(_queue(t), ["song_name"], 2).select("song_name")


@query(f"WITH {QUEUE} SELECT status, count(*) AS n FROM q GROUP BY 1")
def status_counts(t):
    """Rows per status."""
    return metrics.status_counts(_queue(t))


@query("""
SELECT c_custkey AS song_name, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment
   WHEN c_mktsegment = 'HOUSEHOLD' THEN 'alt' ELSE c_mktsegment END AS resolved_tag,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name WHEN c_mktsegment = 'HOUSEHOLD' THEN n_name ELSE c_name END AS resolved_vocalist
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def resolve_tags(t):
    """Tag and singer that a reviewer's choice stands for."""
    alternates = F.array(F.struct(F.lit("nobody").alias("name"), F.lit("none").alias("tag")), F.struct(F.col("n_name").alias("name"), F.lit("alt").alias("tag")))
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    staging = joined.select(F.col("c_custkey").alias("song_name"), F.col("c_mktsegment").alias("tag"), F.col("c_name").alias("primary_vocalist"),
                            alternates.alias("plausible_singers"), F.lit("").alias("canonical_title"))
    chosen = (F.when(F.col("c_acctbal") < 0, "unheard of").when(F.col("c_mktsegment") == "BUILDING", F.lower("c_mktsegment"))
              .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lower("n_name")).when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.upper("c_name")))
    actions = joined.select(F.col("c_custkey").alias("song_name"), chosen.alias("chosen"))
    return R.resolve_tags(actions, staging).select("song_name", "resolved_tag", "resolved_vocalist")


def _promotions(t):
    lyrics = t.documents.select(F.col("doc_id").cast("string").alias("title"),
                                F.when(F.col("lang") == "de", F.concat(F.lit(" [Jerry] "), "text")).otherwise(F.col("text")).alias("lyrics_text"))
    song = F.col("doc_id").cast("string").alias("song_name")
    wanted = t.labels.select(song, F.when(F.col("quality") == 1, "no such title").otherwise("").alias("canonical_title"), F.lit("Jerry").alias("tag"), F.lit("2").alias("decided_at"))
    second = t.labels.filter("toxic = 1").select(song, F.lit("").alias("canonical_title"), F.lit("Bob").alias("tag"), F.lit("3").alias("decided_at"))
    none = t.labels.filter("quality = 0").select(song, F.lit("").alias("canonical_title"), F.when(F.col("toxic") == 1, "").alias("tag"), F.lit("1").alias("decided_at"))
    return R.promote_tags(lyrics, wanted.unionByName(second).unionByName(none))


@query("""
SELECT CAST(d.doc_id AS VARCHAR) AS title, CASE WHEN toxic = 1 THEN '[Bob]' || chr(10) || chr(10) ELSE '' END || CASE WHEN lang = 'de' THEN ' [Jerry] ' || text WHEN l.doc_id IS NOT NULL THEN '[Jerry]' || chr(10) || chr(10) || text ELSE text END AS lyrics_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def promote_tags(t):
    """Lyrics with the approved tag put in front."""
    return _promotions(t)[0]


@query("""
SELECT CAST(l.doc_id AS VARCHAR) AS song_name, 'Jerry' AS tag, CASE WHEN d.doc_id IS NULL THEN 'song not found' ELSE 'already tagged' END AS error
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR lang = 'de'
UNION ALL SELECT CAST(l.doc_id AS VARCHAR), 'Bob', 'song not found' FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL AND toxic = 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN toxic = 1 THEN '' END, 'no tag' FROM labels WHERE quality = 0""")
def promotion_errors(t):
    """Promotions that could not be applied."""
    return _promotions(t)[1]


# -- pages --------------------------------------------------------------------
@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), chr(10) || ' ' || chr(9) || chr(13)) AS body,
 trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
   '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line FROM pages""")
def clean_pages(t):
    """Page text with and without its line structure."""
    return t.pages.select("page_id", clean_html("html").alias("body"), clean_html_line("html").alias("line"))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h,
   regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: string_split(x, '=')[1] = 'page') AS f FROM u)
SELECT page_id, s || '://' || h || p || CASE WHEN len(f) > 0 THEN '?' || array_to_string(f, '&') ELSE '' END AS canonical FROM k""")
def canonical_urls(t):
    """Page URLs without fragment and with paging parameters only."""
    return t.pages.select("page_id", canonical_url("url").alias("canonical"))


LINKS = r"""
h AS (SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hs FROM pages),
e AS (SELECT url, origin, CAST(i AS INTEGER) AS link_no, hs[i + 1] AS href FROM (SELECT *, unnest(range(len(hs))) AS i FROM h)),
links AS (SELECT url AS page, origin, link_no, href FROM e WHERE href LIKE '/%' AND href NOT LIKE '//%')"""


@query(rf"""
WITH {LINKS} SELECT page, link_no, origin || regexp_extract(href, '^([^?#]*)', 1) AS target FROM links""")
def page_links(t):
    """Links of pages to pages of their own site."""
    return P.extract_page_links(t.pages).select("page", "link_no", "target")


@query(rf"""
WITH {LINKS}, x AS (SELECT origin || regexp_extract(href, '^([^?#]*)', 1) AS target, regexp_replace(page, '[?#].*$', '') AS source FROM links)
SELECT target AS url, count(*) AS in_degree, CAST(0 AS BIGINT) AS out_degree FROM x WHERE target NOT IN (SELECT source FROM x) GROUP BY 1
ORDER BY in_degree DESC, url LIMIT 5""")
def most_linked(t):
    """The five most linked pages."""
    return G.most_linked(G.degrees(P.extract_page_links(t.pages).select("source", "target")))


@query(r"""
WITH h AS (SELECT page_id, html FROM pages),
e AS (SELECT page_id, i, regexp_extract_all(html, 'href="(/[^"#?]+)"[^>]*>(.*?)</a>', 1)[i + 1] AS href, regexp_extract_all(html, 'href="(/[^"#?]+)"[^>]*>(.*?)</a>', 2)[i + 1] AS title
  FROM (SELECT *, unnest(range(len(regexp_extract_all(html, 'href="(/[^"#?]+)"[^>]*>(.*?)</a>', 1)))) AS i FROM h)),
k AS (SELECT page_id, i, string_split(href, '/')[-1] AS slug, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')),
   '&amp;?', ' and ', 'g'), '^\s*(?:e\d*|encore|set\s*(?:i{1,3}|\d)|1st set|2nd set|\d+)\s*[:\-.]\s*|^\s*\([^)]*\)\s*', ''), '(^|[^a-z0-9_À-ÿ])the([^a-z0-9_À-ÿ]|$)', '\1 \2', 'g'), '[^a-z0-9]+', ' ', 'g')) AS song_key
  FROM e WHERE trim(regexp_replace(title, '<[^>]+>', '', 'g')) <> '')
SELECT song_key, arg_max(slug, (page_id, i)) AS slug FROM k GROUP BY 1""")
def title_index(t):
    """Song key to slug from pages of links; the last link of a key counts."""
    return P.extract_title_index(t.pages, r'(?s)href="(/[^"#?]+)"[^>]*>(.*?)</a>', page_order="page_id")


@query(r"""
WITH h AS (SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hs,
   regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS ts FROM pages),
e AS (SELECT url AS page, origin, CAST(i AS INTEGER) AS link_no, hs[i + 1] AS href, trim(regexp_replace(ts[i + 1], '<[^>]+>', '', 'g')) AS title FROM (SELECT *, unnest(range(len(hs))) AS i FROM h))
SELECT page, link_no, origin || href AS url, title FROM e WHERE regexp_matches(href, '^/(the|in|de)') AND title <> ''
QUALIFY row_number() OVER (PARTITION BY origin || href ORDER BY page, link_no) = 1""")
def episode_links(t):
    """Links that fit a pattern, first titled occurrence of each."""
    return P.extract_links(t.pages, "^/(the|in|de)")


@query(r"""
SELECT page_id, ord AS track_number, i AS listing_no, title FROM (
  SELECT page_id, 1 AS ord, 1 AS i, 'Last' AS title FROM pages UNION ALL SELECT page_id, 2, 2, page_id || '  & more' FROM pages)""")
def track_tables(t):
    """Numbered two-column rows of HTML tables."""
    table = F.concat(F.lit("<table class='x'><tr><th>No</th><th>Title</th></tr><tr><td>1</td><td>First</td></tr><tr><td> 2 </td><td><b>"),
                     F.col("page_id").cast("string"), F.lit("</b> &gt; &amp; more</td></tr><tr><td>1</td><td>Last</td></tr><tr><td>0</td><td>x</td></tr></table>"))
    pages = t.pages.select(F.col("page_id").alias("url"), F.concat("html", table).alias("html"))
    return P.extract_track_table(pages).withColumnRenamed("url", "page_id")


@query(r"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'), chr(10) || ' ')), lambda x: length(x) > 50) AS ps FROM pages),
d AS (SELECT page_id, regexp_replace(replace(array_to_string(ps, chr(10) || chr(10)), '&quot;', '"'), '&amp;?', '&', 'g') AS transcript FROM p WHERE len(ps) > 0)
SELECT page_id, transcript, len(list_filter(regexp_split_to_array(transcript, '\s+'), lambda w: w <> '')) AS word_count FROM d""")
def transcripts(t):
    """Transcripts of pages: here, their long paragraphs."""
    return P.extract_transcripts(t.pages.select("page_id", "html")).withColumn("word_count", F.col("word_count").cast("long"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'talk ' || page_id || 'more & more' WHEN page_id % 3 = 1 THEN repeat('long ' || page_id || ' ', 20)[1:-2] ELSE 'open end' END AS transcript FROM pages""")
def transcript_blocks(t):
    """Transcripts of pages with a block: nested, empty (the paragraphs count then) or never closed."""
    n = F.col("page_id").cast("string")
    block = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div class="side"><div class="transcript"><div>talk '), n, F.lit("</div><div><div>more &amp; more</div></div></div>rest</div>")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit('<div class="episode-transcript"></div><p>'), F.repeat(F.concat(F.lit("long "), n, F.lit(" ")), 20), F.lit("</p>")))
        .otherwise(F.lit('<section class="transcript">open <i>end</i>')))
    return P.extract_transcripts(t.pages.select("page_id", block.alias("html"))).select("page_id", "transcript")


@query(r"""
SELECT page_id AS slug, 'Song ' || page_id AS title, 'Robert' AS lyricists, 'Jerry,Phil' AS music_by, 'line one' || chr(10) || 'line ' || page_id AS lyrics_text, '1970' AS first_played_hint FROM pages""")
def song_pages_fields(t):
    """Song pages built of field blocks."""
    doc = F.concat(
        F.lit('<html><title>Song '), F.col("page_id").cast("string"), F.lit(' | Site</title><body>'), F.regexp_replace("html", "(?is)first played|<title>.*?</title>", ""),
        F.lit('<article class="node__content"><div class="x field--name-field-lyrics-by"><div class="field__item">Robert (note a)</div></div>'
              '<div class="x field--name-field-music-by"><div class="field__item">Jerry</div><div class="field__item">Phil</div></div>'
              '<div class="x field--name-field-lyrics field"><div class="field__label">Lyrics</div>line one  <br/>line '), F.col("page_id").cast("string"),
        F.lit('</div></article><p>first played in May 1970</p></body></html>'))
    got = P.extract_song_pages_a(t.pages.select(F.col("page_id").cast("string").alias("slug"), doc.alias("html")))["songs"]
    return got.select(F.col("slug").cast("long").alias("slug"), "title", F.array_join("lyricists", ",").alias("lyricists"), F.array_join("music_by", ",").alias("music_by"),
                      "lyrics_text", "first_played_hint")


@query(r"""
SELECT page_id AS url, CAST(n AS INTEGER) AS note_no, 'whitegum-notes' AS source, CASE n WHEN 0 THEN '(a) first note on ' || page_id ELSE '(b) second note, longer' END AS text
FROM pages, range(2) r(n)""")
def song_page_notes(t):
    """Lettered notes of plain song pages."""
    doc = F.concat(F.lit("<title>S</title><pre>\nLyrics: A, B and C\nMusic: D (note a)\nfirst line<br>second\nNotes\n(a) first note\non "),
                   F.col("page_id").cast("string"), F.lit("\n(b) second note, longer\n(c) tiny\nFor more information see</pre>"), F.lit("<!-- "), F.col("html"), F.lit(" -->"))
    got = P.extract_song_pages_b(t.pages.select(F.col("page_id").alias("url"), doc.alias("html")))["interpretations"]
    return got


# -- graphs -------------------------------------------------------------------
def _supply_edges(t):
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return t.lineitem.select(F.explode(F.array(F.struct(s.alias("source"), p.alias("target")), F.struct(p.alias("source"), s.alias("target")))).alias("e")).select("e.*")


SUPPLY = """
e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
walk AS (SELECT 's0' AS node, 0 AS depth UNION SELECT e.target, depth + 1 FROM walk JOIN e ON e.source = walk.node WHERE depth < 3),
lv AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"""


def _levels(t):
    return G.bfs(_supply_edges(t), t.spark.createDataFrame([("s0",)], "node string"), 3)


@query(f"""
WITH RECURSIVE {SUPPLY}
SELECT lv.node, lv.depth, (SELECT min(e.source) FROM e JOIN lv p ON p.node = e.source WHERE e.target = lv.node AND p.depth = lv.depth - 1) AS parent FROM lv""")
def bfs_depths(t):
    """Breadth-first levels of the supplier-part graph with discovering parents."""
    return _levels(t)


@query(f"WITH RECURSIVE {SUPPLY} SELECT depth, count(*) AS n FROM lv GROUP BY 1")
def depth_histogram(t):
    """Nodes per level."""
    return G.depth_histogram(_levels(t))


@query(f"WITH RECURSIVE {SUPPLY} SELECT count(*) AS nodes, max(depth) AS max_depth, count(*) - 1 AS edges FROM lv")
def graph_totals(t):
    """Nodes, edges and depth of the discovery tree."""
    levels = _levels(t)
    return G.graph_totals(levels, G.tree_edges(levels))


@query("""
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem),
n AS (SELECT source AS url, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e)
SELECT url, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM n GROUP BY 1""")
def degrees(t):
    """In- and out-degree of every node."""
    e = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")).distinct()
    return G.degrees(e)


def _regions(t):
    nodes = t.region.select(F.concat(F.lit("h/"), "r_name").alias("url"), F.lit(0).alias("depth")).unionByName(
        t.nation.select(F.concat(F.lit("h/"), "n_name").alias("url"), F.lit(1).alias("depth"))).unionByName(
        t.supplier.select(F.concat(F.lit("h/"), "s_name").alias("url"), F.lit(12).alias("depth")))
    edges = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("h/"), "r_name").alias("source"), F.concat(F.lit("h/"), "n_name").alias("target")).unionByName(
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("h/"), "n_name").alias("source"), F.concat(F.lit("h/"), "s_name").alias("target")))
    return nodes, edges


@query(r"""
SELECT 'digraph site {' AS value UNION ALL SELECT '  rankdir=TB;' UNION ALL SELECT '  node [shape=box, style=filled];' UNION ALL SELECT '}'
UNION ALL SELECT '  "h/' || r_name || '" [label="/\n' || r_name || '", fillcolor="lightblue"];' FROM region
UNION ALL SELECT '  "h/' || n_name || '" [label="/\n' || n_name || '", fillcolor="lightgreen"];' FROM nation
UNION ALL SELECT '  "h/' || s_name || '" [label="/\n' || s_name || '", fillcolor="lightgoldenrodyellow"];' FROM supplier
UNION ALL SELECT '  "h/' || r_name || '" -> "h/' || n_name || '";' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT '  "h/' || n_name || '" -> "h/' || s_name || '";' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def graph_description(t):
    """Description lines of the region, nation and supplier tree."""
    nodes, edges = _regions(t)
    return G.graph_dot_lines(nodes, edges, "site", "h").select("value")


@query("""
SELECT 'h/' || s_name AS url, CAST(12 AS INTEGER) AS depth, CAST(1 AS INTEGER) AS in_degree, CAST(0 AS INTEGER) AS out_degree FROM supplier
UNION ALL SELECT 'h/' || n_name, 1, 1, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS INTEGER) FROM nation
UNION ALL SELECT 'h/' || r_name, 0, 0, CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS INTEGER) FROM region""")
def graph_csv(t):
    """Node table written as CSV with its edges and read back."""
    nodes, edges = _regions(t)
    table = G.node_table(nodes.withColumnRenamed("url", "node"), edges)
    n, e = scratch_path(t.spark, "nodes"), scratch_path(t.spark, "edges")
    write_graph_csv(table, edges.withColumn("source_depth", F.lit(0)).withColumn("target_depth", F.lit(1)), n, e)
    return read_graph_csv(t.spark, n, e)[0]
