"""Shows, set lists, durations, merging and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from liveset.functions.dates import long_date, show_date
from liveset.functions.text import duration_display, duration_seconds
from liveset.operators import durations as D
from liveset.operators import merge as M
from liveset.operators import metrics
from liveset.operators import setlists as S
from liveset.queries import query
from liveset.scale import hot_buckets, scratch_path
from liveset.sources.readers import read_items
from liveset.sources.sinks import append_transcripts as append_rows
from liveset.sources.sinks import publish, read_current
from liveset.streaming import ingest as I
from liveset.streaming import keyed as K

LINE = ["l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = "l_linenumber, l_partkey, l_suppkey"
SHOW = "show_identifier"


def _show_key(t):
    return t.orders.select("o_orderkey", F.format_string(
        "gd%s.sbd.%d", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey").alias(SHOW))


def _hot(t, key: str = "l_orderkey", name: str = SHOW):
    """Overfull shows, counted once on the key column of the base table."""
    return hot_buckets(t.raw("lineitem").select(F.col(key).alias(name)), [name])


SHOW_SQL = "'gd' || strftime(o_orderdate, '%Y-%m-%d') || '.sbd.' || o_orderkey"


# -- set lists ----------------------------------------------------------------
@query(f"""
WITH l AS (SELECT *, coalesce(l_returnflag <> lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}), true) AS b
           FROM lineitem)
SELECT l_orderkey, {LINE_SQL},
       CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS set_no FROM l""")
def set_numbers(t):
    """Set number of each line: running count of the lines that start a set."""
    rows = t.lineitem.select("l_orderkey", *LINE, "l_returnflag")
    hot = _hot(t)
    flagged = S.previous_value(rows, ["l_orderkey"], LINE, "l_returnflag", "before", hot=hot)
    starts = F.coalesce(F.col("l_returnflag") != F.col("before"), F.lit(True))
    return S.set_numbers(flagged, ["l_orderkey"], LINE, starts, hot=hot).select("l_orderkey", *LINE, "set_no")


@query(f"""
WITH l AS (SELECT l_orderkey, {LINE_SQL}, l_returnflag, p_name AS transition_to,
             lag(p_name) OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS transition_from
           FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, {LINE_SQL}, transition_from, transition_to FROM l
WHERE l_returnflag = 'R' AND transition_from IS NOT NULL""")
def transitions(t):
    """Segue pairs: a song after a segue mark with its predecessor."""
    songs = t.lineitem.select("l_orderkey", *LINE, "l_returnflag").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    pairs = S.transitions_in_order(songs, ["l_orderkey"], LINE, "p_name", F.col("l_returnflag") == "R", hot=_hot(t))
    return pairs.select("l_orderkey", *LINE, "transition_from", "transition_to")


def _described(t):
    text = F.concat(F.lit("Intro, not a song<br/>Disc 1 opening<br />"), F.col("text"), F.lit("<br>Encore<br>"), F.col("source"),
                    F.lit(" -> <b>"), F.col("lang"), F.lit("</b>,Closer*^<br>Source: tape\nOther artist(s): "),
                    F.col("lang"), F.lit(", ,"), F.col("source"))
    return t.documents.select(F.col("doc_id").alias(SHOW), text.alias("description"))


DESCRIBED = r"""
lines AS (SELECT doc_id, source, lang, i AS line_no, trim(string_split(text, chr(10))[i + 1]) AS line
  FROM (SELECT *, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS n FROM lines WHERE line <> ''),
items AS (SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST(j AS INTEGER) AS item_no, trim(string_split(line, ',')[j + 1]) AS item
  FROM (SELECT *, unnest(range(len(string_split(line, ',')))) AS j FROM kept)
  WHERE NOT regexp_matches(line, '^(Other artist|Notes:|Source|Soundline|MMA|Recorded|Transfer)', 'i'))
"""


@query(rf"""
WITH {DESCRIBED},
names AS (SELECT doc_id, line_no, item_no, item FROM items
          WHERE item <> '' AND NOT regexp_matches(item, '^(Set|Disc|Encore)', 'i')),
noted AS (SELECT *, regexp_matches(item, '[*^0-9]+(\s|$)') AS has FROM names),
songs AS (SELECT doc_id, 0 AS set_order, 'Set 1' AS set_name, line_no, item_no, false AS transition,
            CASE WHEN has THEN trim(regexp_replace(item, '[*^0-9\s]+$', '')) ELSE item END AS song_name FROM noted
  UNION ALL SELECT doc_id, 1, 'Encore', 0, 0, true, source FROM documents WHERE NOT regexp_matches(source, '[0-9]$')
  UNION ALL SELECT doc_id, 1, 'Encore', 0, 0, true, regexp_replace(source, '[0-9]+$', '') FROM documents WHERE regexp_matches(source, '[0-9]$')
  UNION ALL SELECT doc_id, 1, 'Encore', 0, 1, false, 'Closer' FROM documents
)
SELECT doc_id AS show_identifier, set_order, line_no, item_no, set_name, song_name, transition FROM songs WHERE song_name <> ''""")
def extract_setlist_songs(t):
    """Songs of free-text descriptions, with their sets."""
    return S.show_songs(S.set_entries(_described(t))).drop("notations")


@query(rf"""
WITH {DESCRIBED},
names AS (SELECT doc_id, 0 AS set_order, line_no, item_no, item FROM items WHERE item <> '' AND NOT regexp_matches(item, '^(Set|Disc|Encore)', 'i')
  UNION ALL SELECT doc_id, 1, 0, 0, source FROM documents UNION ALL SELECT doc_id, 1, 0, 1, 'Closer*^' FROM documents)
SELECT doc_id AS show_identifier, set_order, line_no, item_no, array_to_string(m, '|') AS notations
FROM (SELECT *, regexp_extract_all(item || ' ', '([*^0-9]+)\s', 1) AS m FROM names) WHERE len(m) > 0
  AND trim(regexp_replace(item, '[*^0-9\s]+$', '')) <> ''""")
def extract_setlist_notations(t):
    """Notation marks of the songs of free-text descriptions."""
    songs = S.show_songs(S.set_entries(_described(t))).filter(F.size("notations") > 0)
    return songs.select(SHOW, "set_order", "line_no", "item_no", F.array_join("notations", "|").alias("notations"))


@query("""
SELECT doc_id AS show_identifier, 1 AS set_order, 0 AS line_no, 0 AS item_no, source AS transition_from, lang AS transition_to
FROM documents""")
def extract_setlist_transitions(t):
    """Segues written with arrows in free-text descriptions."""
    return S.show_transitions(S.set_entries(_described(t)))


@query("""
SELECT doc_id AS show_identifier, 0 AS guest_no, lang AS guest_artist FROM documents
UNION ALL SELECT doc_id, 2, source FROM documents""")
def extract_setlist_guests(t):
    """Guests named in free-text descriptions."""
    return S.show_guests(_described(t))


@query("""
SELECT p_partkey AS show_identifier, 0 AS set_order, 0 AS line_no, 0 AS item_no, 'Set I' AS set_name, p_type AS song_name, false AS transition FROM part
UNION ALL SELECT p_partkey, 1, 0, 0, 'Set II', p_name, false FROM part
UNION ALL SELECT p_partkey, 1, 0, 1, 'Set II', 'Dark Star', true FROM part
UNION ALL SELECT p_partkey, 1, 0, 2, 'Set II', 'Sugar Magnolia', true FROM part
UNION ALL SELECT p_partkey, 2, 1, 0, 'Encore', p_brand, false FROM part""")
def legacy_setlist_songs(t):
    """Songs of legacy lists: default set, markers with songs, known titles cut apart."""
    entries = F.array("p_type", F.concat(F.lit("Set II "), "p_name", F.lit(" &gt; dark star sugar magnolia")),
                      F.lit("Encore"), F.col("p_brand"), F.lit("A - guitar"))
    lists = t.part.select(F.col("p_partkey").alias(SHOW), entries.alias("entries"))
    return S.normalize_legacy(lists)["songs"]


@query("""
SELECT p_partkey AS show_identifier, 1 AS set_order, 0 AS line_no, 1 AS item_no, p_name AS transition_from, 'Dark Star' AS transition_to FROM part
UNION ALL SELECT p_partkey, 1, 0, 2, 'Dark Star', 'Sugar Magnolia' FROM part""")
def legacy_setlist_transitions(t):
    """Segues of legacy lists: each song after an arrow with its predecessor."""
    entries = F.array("p_type", F.concat(F.lit("Set II "), "p_name", F.lit(" &gt; dark star sugar magnolia")), F.lit("Encore"))
    return S.normalize_legacy(t.part.select(F.col("p_partkey").alias(SHOW), entries.alias("entries")))["transitions"]


@query("""
WITH n AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
s AS (SELECT p_partkey, 0 AS k, 'Jam' AS name FROM n UNION ALL SELECT p_partkey, 1, p_name FROM n UNION ALL SELECT p_partkey, 2, p_brand FROM part
  UNION ALL SELECT p_partkey, 3, p_name FROM n)
SELECT p_partkey AS show_identifier, 0 AS set_order, 0 AS line_no, CAST(k AS INTEGER) AS item_no, 'Set I' AS set_name,
  CASE WHEN k IN (1, 3) THEN array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE name END AS song_name,
  k = 3 AS transition
FROM s""")
def legacy_catalog_songs(t):
    """Legacy lists cut by a catalogue of titles that comes from a table, of any size."""
    titles = t.part.select(F.col("p_name").alias("title")).union(t.supplier.select("s_name")).union(t.customer.select("c_name"))
    entries = F.array(F.concat(F.lit("Jam "), F.upper("p_name"), F.lit(" "), F.col("p_brand"), F.lit("&gt;"), F.col("p_name")))
    return S.normalize_legacy(t.part.select(F.col("p_partkey").alias(SHOW), entries.alias("entries")), titles=titles)["songs"]


@query(r"""
WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)
SELECT doc_id AS show_identifier, CAST(i AS INTEGER) AS item_no, 0 AS part_no, trim(string_split(f, ',')[i + 1]) AS song_name
FROM (SELECT *, unnest(range(len(string_split(f, ',')))) AS i FROM flat) WHERE trim(string_split(f, ',')[i + 1]) <> ''""")
def flat_songs(t):
    """Every comma- and arrow-separated part of a description."""
    return S.flat_songs(t.documents.select(F.col("doc_id").alias(SHOW), F.col("text").alias("description")))


SKIP_SQL = ("comment|crew|sound|light|stage|monitors|other artist|guests|guest|band|members|jerry garcia|bob weir|phil lesh|"
            "bill kreutzmann|mickey hart|keith godchaux|donna jean|ronn cuomo|donna godchaux|vocals|guitar|bass|drums|"
            "keyboards|misc|tune|banter|announcement|speech")


@query(rf"""
WITH lines AS (SELECT doc_id, i, trim(string_split(text, chr(10))[i + 1]) AS line
  FROM (SELECT *, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM lines WHERE line <> ''),
ok AS (SELECT * FROM kept WHERE NOT regexp_matches(line, '^(Set|Disc|Encore)', 'i') AND NOT regexp_matches(lower(line), '{SKIP_SQL}')),
items AS (SELECT doc_id, n, j, trim(string_split(line, ',')[j + 1]) AS item FROM (SELECT *, unnest(range(len(string_split(line, ',')))) AS j FROM ok))
SELECT doc_id AS show_identifier, CAST(n AS INTEGER) AS line_no, CAST(j AS INTEGER) AS item_no, item AS song_name
FROM items WHERE item <> '' AND NOT regexp_matches(item, '^(Set|Disc|Encore)', 'i')""")
def ordered_songs(t):
    """Base songs in order, credits and crew lines skipped."""
    return S.ordered_songs(t.documents.select(F.col("doc_id").alias(SHOW), F.col("text").alias("description")))


@query("SELECT count(*) FILTER (WHERE props LIKE '{%') AS rich, count(*) FILTER (WHERE props LIKE '[%') AS legacy, count(*) AS setlists FROM events")
def setlist_formats(t):
    """How many raw values are objects and how many lists."""
    return S.legacy_or_rich(t.events.select(F.col("props").alias("value")))


# -- dates and durations ------------------------------------------------------
@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y4, CAST(year(o_orderdate) AS INTEGER) AS y2,
       CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d,
       strftime(o_orderdate, '%B %d, %Y') AS shown FROM orders""")
def show_dates(t):
    """Dates of show keys with four- and two-digit years, and their long form."""
    read = t.orders.select(
        "o_orderkey", show_date(F.concat(F.lit("gd"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".sbd"))).alias("a"),
        show_date(F.concat(F.lit("gd"), F.date_format("o_orderdate", "yy-MM-dd"), F.lit(".aud"))).alias("b"),
        long_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shown"))
    return read.select("o_orderkey", F.col("a.year").alias("y4"), F.col("b.year").alias("y2"), F.col("a.month").alias("m"),
                       F.col("a.day").alias("d"), "shown")


@query(f"""
SELECT l_orderkey, {LINE_SQL}, CAST(l_linenumber * 60 + l_quantity AS DOUBLE) AS clock, l_extendedprice AS plain,
       CAST(NULL AS DOUBLE) AS unread,
       CAST(floor(l_extendedprice / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS shown
FROM lineitem""")
def duration_readings(t):
    """Clock and plain durations to seconds, seconds to a clock."""
    clock = F.format_string("%d:%02d", "l_linenumber", F.col("l_quantity").cast("int"))
    return t.lineitem.select("l_orderkey", *LINE, duration_seconds(clock).alias("clock"),
                             duration_seconds(F.col("l_extendedprice").cast("string")).alias("plain"),
                             duration_seconds("l_returnflag").alias("unread"), duration_display("l_extendedprice").alias("shown"))


@query("""
SELECT p_partkey AS show_identifier, 0 AS file_no, p_name || '.flac' AS name, p_name AS title, '5:00' AS length, 'FLAC' AS format FROM part
UNION ALL SELECT p_partkey, 2, p_name || '.mp3', '', '301.5', 'VBR MP3' FROM part""")
def audio_files(t):
    """Audio files of items; other formats and text files drop out."""
    def file(name, title, length, format_):
        return F.struct(name.alias("name"), title.alias("title"), F.lit(length).alias("length"), F.lit(format_).alias("format"))

    named = lambda end: F.concat("p_name", F.lit(end))
    files = F.array(file(named(".flac"), F.col("p_name"), "5:00", "FLAC"), file(named(".txt"), F.lit("x"), "1", "FLAC"),
                    file(named(".mp3"), F.lit(None).cast("string"), "301.5", "VBR MP3"), file(named(".gif"), F.lit("x"), "1", "GIF"))
    return D.audio_files(t.part.select(F.col("p_partkey").alias(SHOW), files.alias("files")))


def _line_files(t):
    """Audio files of a show: one per line, disc by line number, track by supplier."""
    name = F.format_string("gd%dd%dt%02d.%s", "l_orderkey", "l_linenumber", F.pmod("l_suppkey", F.lit(7)).cast("int"), "l_returnflag")
    length = F.when(F.col("l_linestatus") == "O", F.format_string("%d:%02d", F.col("l_quantity").cast("int"), "l_linenumber"))
    return t.lineitem.select(F.col("l_orderkey").alias(SHOW), "l_partkey", "l_suppkey", "l_linenumber", name.alias("name"), length.alias("length"))


FILES_SQL = """
f AS (SELECT l_orderkey, l_linenumber AS disc, CAST(l_suppkey % 7 AS INTEGER) AS track,
        'gd' || l_orderkey || 'd' || l_linenumber || 't' || lpad(CAST(l_suppkey % 7 AS VARCHAR), 2, '0') || '.' || l_returnflag AS name,
        CASE WHEN l_linestatus = 'O' THEN l_quantity * 60 + l_linenumber END AS secs FROM lineitem),
best AS (SELECT l_orderkey, disc, track, name, secs FROM f
   QUALIFY row_number() OVER (PARTITION BY l_orderkey, disc, track ORDER BY secs DESC NULLS LAST, name) = 1),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY disc, track) AS track_no FROM best)
"""


@query(f"""
WITH {FILES_SQL}
SELECT l_orderkey AS show_identifier, disc, track AS track_in_disc, name AS file_name, CAST(secs AS DOUBLE) AS duration_seconds, track_no FROM numbered""")
def track_best(t):
    """Longest take per disc and track, numbered across discs."""
    return D.track_best(_line_files(t)).select(
        SHOW, "disc", "track_in_disc", "file_name", "duration_seconds", "track_no")


@query("""
WITH s AS (SELECT l_orderkey AS k, lower(p_name) AS m, min_by(p_name, (l_linenumber, l_partkey, l_suppkey)) AS song_name
           FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N' GROUP BY 1, 2),
tr AS (SELECT l_orderkey AS k, lower(p_name) AS m, l_quantity, l_linenumber, l_partkey, l_suppkey
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N')
SELECT s.k AS show_identifier, song_name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS length FROM s JOIN tr USING (k, m)
QUALIFY row_number() OVER (PARTITION BY s.k, m ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def title_match(t):
    """Songs of a show to its tracks by title; a later track of one title counts."""
    songs, tracks = _songs_and_tracks(t)
    return D.match_tracks_by_title(songs, tracks, LINE, LINE)[0].select(SHOW, "song_name", "length")


def _songs_and_tracks(t):
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn(
        SHOW, F.col("l_orderkey"))
    songs = named.filter("l_returnflag = 'N'").select(SHOW, *LINE, F.col("p_name").alias("song_name"))
    tracks = named.filter("l_returnflag <> 'N'").select(
        SHOW, *LINE, F.concat(F.upper("p_name"), F.lit(" ->")).alias("title"), F.col("l_quantity").cast("int").cast("string").alias("length"))
    return songs, tracks


@query("""
WITH s AS (SELECT l_orderkey AS k, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n
           FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N'),
tr AS (SELECT l_orderkey AS k, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n
       FROM lineitem WHERE l_returnflag <> 'N')
SELECT k AS show_identifier, p_name AS song_name, CAST(CAST(max_by(l_quantity, n) AS INTEGER) AS VARCHAR) AS length
FROM s JOIN tr USING (k, n) GROUP BY 1, 2""")
def positional_match(t):
    """The k-th song of a show to its k-th track."""
    songs, tracks = _songs_and_tracks(t)
    return D.match_tracks_by_position(songs, tracks, LINE, LINE, out=["length"], hot=_hot(t)).select(SHOW, "song_name", "length")


@query("""
WITH l AS (SELECT l_orderkey AS k, CASE WHEN l_linestatus = 'O' THEN l_quantity * 60 + l_linenumber END AS secs, l_returnflag, p_name,
     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n
   FROM lineitem JOIN part ON l_partkey = p_partkey),
title AS (SELECT k, secs FROM l WHERE l_returnflag = 'R' AND contains(p_name, 'red widget') QUALIFY row_number() OVER (PARTITION BY k ORDER BY n) = 1),
place AS (SELECT k, secs FROM l WHERE p_name = 'red widget' QUALIFY row_number() OVER (PARTITION BY k ORDER BY n) = 1)
SELECT s.k AS show_identifier, CAST(coalesce(title.secs, place.secs) AS DOUBLE) AS duration_seconds,
   CASE WHEN title.secs IS NOT NULL THEN 'ia_title_match' WHEN place.secs IS NOT NULL THEN 'positional_fallback' END AS source
FROM (SELECT DISTINCT k FROM l) s LEFT JOIN title ON s.k = title.k LEFT JOIN place ON s.k = place.k""")
def song_durations(t):
    """Duration of one song in every show: file title first, position last."""
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn(
        SHOW, F.col("l_orderkey"))
    hot = _hot(t)
    files = D.row_ordinal(named, [SHOW], LINE, "file_no", hot=hot).select(
        SHOW, "file_no", F.format_string("d1t%02d", F.col("file_no")).alias("name"),
        F.when(F.col("l_returnflag") == "R", F.concat("p_name", F.lit(" >"))).otherwise("").alias("title"),
        F.when(F.col("l_linestatus") == "O", F.format_string("%d:%02d", F.col("l_quantity").cast("int"), "l_linenumber")).alias("length"))
    songs = named.select(SHOW, F.col("l_linenumber").alias("line_no"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("item_no"),
                         F.col("p_name").alias("song_name"))
    found = D.song_durations(named.select(SHOW), files, songs, "red widget", hot=hot)
    return found.select(SHOW, "duration_seconds", "source")


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_quantity, l_linestatus, p_name,
     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n
   FROM lineitem JOIN part ON l_partkey = p_partkey),
tracks AS (SELECT k, n, CASE WHEN l_linestatus = 'O' THEN l_quantity * 60 + ln END AS secs FROM l),
place AS (SELECT k, min(n) FILTER (WHERE p_name = 'red widget') AS n FROM l GROUP BY k)
SELECT k AS show_identifier, CAST(secs AS DOUBLE) AS duration_seconds, 'positional_fallback' AS source
FROM place JOIN tracks USING (k, n) WHERE secs IS NOT NULL""")
def duration_by_position(t):
    """Duration of one song by its place in the set order."""
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn(
        SHOW, F.col("l_orderkey"))
    hot = _hot(t)
    numbered = D.row_ordinal(named, [SHOW], LINE, "file_no", hot=hot)
    files = numbered.select(SHOW, F.format_string("d1t%02d", F.col("file_no")).alias("name"),
                            F.when(F.col("l_linestatus") == "O", F.format_string(
                                "%d:%02d", F.col("l_quantity").cast("int"), "l_linenumber")).alias("length"))
    songs = named.select(SHOW, *LINE, F.col("p_name").alias("song_name"))
    return D.by_position(songs, D.checkpoint(D.track_best(files, hot=hot)), "red widget", LINE, hot=hot).select(SHOW, "duration_seconds", "source")


@query("""
WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS secs FROM lineitem GROUP BY 1, 2),
numbered AS (SELECT k, secs, row_number() OVER (PARTITION BY k ORDER BY n) AS n FROM f),
listing AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT k AS show_identifier, min_by(secs, n) AS duration_seconds, 'deadtracks_direct' AS source
FROM numbered JOIN listing USING (k, n) GROUP BY k""")
def track_table_match(t):
    """An external numbered track listing against the audio files of a show."""
    files = t.lineitem.select(F.col("l_orderkey").alias(SHOW), F.format_string("d1t%02d", "l_linenumber").alias("name"),
                              F.col("l_quantity").cast("string").alias("length"))
    listing = t.lineitem.select(F.col("l_orderkey").alias(SHOW), F.col("l_linenumber").alias("track_number"),
                                F.col("l_linenumber").alias("listing_no"),
                                F.when(F.col("l_returnflag") == "R", "Long Song").otherwise("Other").alias("title")).distinct()
    hot = _hot(t)
    matched = D.match_track_table(listing, D.checkpoint(D.track_best(files, hot=hot)), "long song", hot=hot)
    return matched.filter("source = 'deadtracks_direct'").select(SHOW, "duration_seconds", "source")


def _durations(t):
    shows = _show_key(t)
    return t.lineitem.join(shows, F.col("l_orderkey") == F.col("o_orderkey")).select(
        SHOW, *LINE, (F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("duration_seconds"))


@query(f"""
WITH d AS (SELECT {SHOW_SQL} AS show_identifier, {LINE_SQL}, l_quantity * 10 + l_linenumber AS duration_seconds,
             strftime(o_orderdate, '%Y-%m-%d') AS show_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           ORDER BY duration_seconds DESC, show_identifier, {LINE_SQL} LIMIT 20),
v AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS show_date, min(n_name) AS known_venue FROM orders
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT show_identifier, {LINE_SQL}, duration_seconds,
  CAST(floor(duration_seconds / 60) AS BIGINT) || ':' || lpad(CAST(CAST(duration_seconds AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration_formatted,
  coalesce(known_venue, 'Unknown venue') AS venue
FROM d LEFT JOIN v USING (show_date)""")
def top_durations(t):
    """The longest performances, with venues looked up by date."""
    venues = (
        t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("show_date")).agg(F.min("n_name").alias("known_venue")))
    top = D.top_durations(_durations(t), 20, tie_break=(SHOW, *LINE))
    return D.with_venue(top, venues).select(SHOW, *LINE, "duration_seconds", "duration_formatted", "venue")


@query(f"""
WITH d AS (SELECT {SHOW_SQL} AS s, l_quantity * 10 + l_linenumber AS secs, l_returnflag, {LINE_SQL} FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
top AS (SELECT *, row_number() OVER (ORDER BY secs DESC, s, {LINE_SQL}) AS rank FROM d ORDER BY rank LIMIT 10)
SELECT CAST(rank AS INTEGER) AS rank, '| ' || rank || ' | ' || s || ' | ' || CAST(floor(secs / 60) AS BIGINT) || ':' || lpad(CAST(CAST(secs AS BIGINT) % 60 AS VARCHAR), 2, '0')
   || ' | part ' || l_partkey || ' | ' || 'title' || ' |' AS value FROM top""")
def ranking_report(t):
    """Top ten as lines of a markdown table."""
    top = D.top_durations(_durations(t), 10, tie_break=(SHOW, *LINE)).withColumn("all", F.lit(1))
    ranked = M.top_per_key(top, ["all"], [F.desc("duration_seconds"), SHOW, *LINE], 10)
    return metrics.ranking_lines(ranked.withColumn("track_file", F.format_string("part %d", "l_partkey")).withColumn("source", F.lit("title")))


@query("""
SELECT CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'N' THEN 'external' ELSE 'positional' END AS match_kind, count(*) AS n
FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 UNION ALL SELECT 'none', count(*) FROM lineitem WHERE l_linestatus <> 'O'""")
def match_sources(t):
    """How many durations came from which kind of match."""
    source = F.when(F.col("l_returnflag") == "A", "ia_title_match").when(F.col("l_returnflag") == "N", "deadtracks_direct").otherwise("positional_fallback")
    return D.source_breakdown(t.lineitem.select(F.when(F.col("l_linestatus") == "O", source).alias("source")))


# -- merging ------------------------------------------------------------------
@query("""
SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedup_documents(t):
    """First copy of every text."""
    return M.first_per_key(t.documents, ["text"], ["doc_id"]).select("doc_id", "source", "lang", "n_chars")


def _comments(t):
    return t.documents.select(F.col("source").alias(SHOW), F.col("text").alias("comment_text"), F.lit(0).alias("file_no"),
                              F.col("doc_id").alias("pos"))


@query("""
WITH kept AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1)
SELECT (SELECT count(*) FROM documents) AS comments_read, (SELECT count(*) FROM kept) AS comments_total,
       (SELECT count(DISTINCT source) FROM documents) AS shows_total,
       (SELECT count(*) FROM documents) - (SELECT count(*) FROM kept) AS comments_deduplicated""")
def merge_report(t):
    """Copies removed when merging comments by show and text."""
    comments = _comments(t)
    return metrics.side_by_side(M.merge_report(comments, M.merge_comments(comments), shows=comments.select(SHOW))).select(
        "comments_read", "comments_total", "shows_total", "comments_deduplicated")


@query("""SELECT source AS show_identifier, doc_id AS pos, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1""")
def merge_setlists(t):
    """First record per show over files in order."""
    rows = t.documents.select(F.col("source").alias(SHOW), F.lit(0).alias("file_no"), F.col("doc_id").alias("pos"), "lang")
    return M.merge_setlists(rows).select(SHOW, "pos", "lang")


@query(r"""
SELECT conv_id || '-' || turn AS show_identifier, CAST(turn AS VARCHAR) AS comment_id,
  CASE WHEN role = 'system' THEN 'anonymous' ELSE role END AS reviewer, trim(regexp_replace(text, '\s+', ' ', 'g')) AS comment_text,
  CAST(NULL AS INTEGER) AS rating, '' AS created,
  length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 10 AND regexp_matches(lower(text),
   'song|jam|play|show|set|music|sound|experience|played|grateful|dead|band|performance|version|transition|segue|audience|crowd|venue|atmosphere|dark star|turn on|estimated|eyes|truckin|bertha|terrapin|china cat|morning dew|good lovin|uncle john|sugar magnolia') AS is_relevant
FROM conversations""")
def normalize_reviews(t):
    """Reviews with collapsed text, reviewer fallback and relevance flag."""
    review = F.struct(
        F.col("turn").cast("string").alias("reviewidentifier"), F.when(F.col("role") != "system", F.col("role")).otherwise("").alias("username"),
        F.col("text").alias("reviewbody"), F.lit(None).cast("int").alias("stars"), F.lit(None).cast("string").alias("reviewdate"))
    items = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias(SHOW), F.array(review).alias("reviews"))
    return M.normalize_reviews(items).drop("review_no")


@query(r"""
SELECT doc_id, length(trim(text)) >= 10 AND regexp_matches(lower(text), 'the|und|une') AS is_relevant FROM documents WHERE trim(text) <> ''""")
def relevant_documents(t):
    """Non-empty texts flagged by keywords."""
    return M.flag_relevant(M.non_empty(t.documents, "text"), ["the", "und", "une"], "text").select("doc_id", "is_relevant")


@query("""
SELECT c_custkey AS show_identifier, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE n_name END AS venue,
  CASE WHEN c_acctbal < 0 THEN 'y' || c_nationkey ELSE 'd' || c_custkey END AS date,
  trim(c_name || chr(10) || n_name) AS description,
  CASE WHEN c_acctbal < 0 THEN c_mktsegment || ' a b' ELSE c_mktsegment END AS setlist,
  CASE WHEN c_acctbal < 0 THEN 's1,s2' ELSE n_name END AS subject, c_mktsegment AS taper
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def extended_metadata(t):
    """Item fields resolved over their alternatives; lists joined, markup removed."""
    in_debt = F.col("c_acctbal") < 0
    none = F.lit(None).cast("string")
    fields = {
        "date": F.when(~in_debt, F.concat(F.lit("d"), "c_custkey")).otherwise(""), "year": F.when(in_debt, F.concat(F.lit("y"), "c_nationkey")),
        "venue": F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")), "location": F.col("n_name"),
        "description": F.concat("c_name", F.lit("<br/>"), F.lit("<i>"), "n_name", F.lit("</i> ")),
        "setlist": F.col("c_mktsegment"), "notes": F.when(in_debt, F.lit('["a", "b"]')),
        "subject": F.when(in_debt, F.lit('["s1","s2"]')).otherwise(F.col("n_name")), "taper": F.col("c_mktsegment"),
    }
    names = ["identifier", "title", "date", "year", "performance_date", "coverage", "venue", "location", "spatial", "creator", "description",
             "setlist", "notes", "lineage", "track", "subject", "source", "taper", "transferer", "runtime"]
    items = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias(SHOW), F.struct(*[fields.get(n, none).alias(n) for n in names]).alias("metadata"))
    return M.extended_metadata(items).select(
        SHOW, "venue", "date", "description", "setlist", F.array_join("subject", ",").alias("subject"), "taper")


@query("""
WITH e AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS taper, max(o_orderpriority) FILTER (WHERE false) AS x FROM orders GROUP BY 1)
SELECT c_custkey AS show_identifier, taper FROM customer LEFT JOIN e ON c_custkey = o_custkey""")
def enrich_shows(t):
    """Existing shows with the latest filled extended fields."""
    shows = t.customer.select(F.col("c_custkey").alias(SHOW))
    extended = t.orders.select(F.col("o_custkey").alias(SHOW), F.col("o_orderstatus").alias("taper"), F.lit("").alias("transferer"),
                               F.lit(None).cast("string").alias("runtime"), F.lit("").alias("source"),
                               F.array().cast("array<string>").alias("subject"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return M.enrich_shows(shows, extended, "at").select(SHOW, F.col("extended_metadata")["taper"].alias("taper"))


@query("SELECT c_custkey AS show_identifier, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def new_items(t):
    """Listed keys that were not processed yet."""
    return M.new_items(t.customer.select(F.col("c_custkey").alias(SHOW), "c_name"), t.orders.select(F.col("o_custkey").alias(SHOW)))


@query("SELECT c_custkey AS show_identifier, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def known_items(t):
    """Listed keys that belong to known shows."""
    return M.restrict_to(t.customer.select(F.col("c_custkey").alias(SHOW), "c_name"), t.orders.select(F.col("o_custkey").alias(SHOW)))


@query("SELECT o_orderkey AS show_identifier FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_items(t):
    """Processed shows whose set list is gone."""
    return M.missing_items(t.orders.select(F.col("o_orderkey").alias(SHOW)), t.lineitem.select(F.col("l_orderkey").alias(SHOW)))


@query("""
SELECT c_custkey AS show_identifier FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) ORDER BY 1 LIMIT 50""")
def next_batch(t):
    """The first fifty new keys: a harvest run stops at its target."""
    return M.new_items(t.customer.select(F.col("c_custkey").alias(SHOW)), t.orders.select(F.col("o_custkey").alias(SHOW)), target=50)


@query("""
SELECT o_orderkey AS show_identifier, 'existing' AS origin FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT o_orderkey, 'parsed' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def backfill(t):
    """Existing set lists, and parsed ones for shows that had none."""
    key = F.col("l_orderkey").alias(SHOW)
    existing = t.lineitem.filter("l_returnflag = 'R'").select(key).distinct().withColumn("origin", F.lit("existing"))
    parsed = t.lineitem.select(key).distinct().withColumn("origin", F.lit("parsed"))
    return M.backfill(t.orders.select(F.col("o_orderkey").alias(SHOW)), existing, parsed)


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS items_read, max(o_custkey) AS num_found, count(*) >= max(o_custkey) AS complete
FROM orders GROUP BY 1""")
def year_status(t):
    """Years whose every page was read."""
    pages = t.orders.select(F.year("o_orderdate").alias("year"), F.lit(1).alias("items_read"), F.col("o_custkey").alias("num_found"))
    return M.year_status(pages)


@query("""
WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS total FROM orders GROUP BY 1),
p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS processed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT year, total, coalesce(processed, 0) AS processed, total - coalesce(processed, 0) AS remaining FROM a LEFT JOIN p USING (year)""")
def year_counts(t):
    """Processed and remaining shows per year of the show key."""
    keys = _show_key(t).join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    totals = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("total"))
    return metrics.year_counts(keys.filter("o_orderstatus = 'F'"), totals)


@query("""
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_last_wins(t):
    """Latest row per key."""
    return M.last_wins(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT CAST(user_id AS VARCHAR) AS song_name, event_type AS status, CAST(ts AS VARCHAR) AS decided_at FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def apply_decisions(t):
    """Decisions under last-wins by time."""
    rows = t.events.select(F.col("user_id").cast("string").alias("song_name"), F.col("event_type").alias("status"),
                           F.col("ts").cast("string").alias("decided_at"))
    return M.apply_decisions(rows)


@query("""
SELECT conv_id AS show_identifier, turn, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')
UNION ALL SELECT conv_id, turn, 'new ' || text FROM conversations WHERE role = 'system'""")
def upsert_comments(t):
    """Shows with incoming reviews take them in place of the old ones."""
    base = t.conversations.select(F.col("conv_id").alias(SHOW), "turn", "text", "role")
    incoming = base.filter("role = 'system'").withColumn("text", F.concat(F.lit("new "), "text"))
    return M.upsert_comments(base, incoming).drop("role")


@query("""
SELECT s_suppkey AS show_identifier, s_name AS venue FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 3 FROM customer)
UNION ALL SELECT c_custkey * 3, c_name FROM customer""")
def upsert_setlists(t):
    """Set lists of shows that came in again replace those kept."""
    kept = t.supplier.select(F.col("s_suppkey").alias(SHOW), F.col("s_name").alias("venue"))
    came = t.customer.select((F.col("c_custkey") * 3).alias(SHOW), F.col("c_name").alias("venue"))
    return M.upsert_setlists(kept, came)



@query("""
SELECT event_id, user_id FROM events e WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events x WHERE x.user_id = e.user_id)""")
def replace_by_key(t):
    """Rows of the latest batch (a day) that brought any for their key."""
    log = t.events.select("event_id", "user_id", F.date_trunc("day", "ts").alias(I.BATCH))
    return I.replace_by_key(log, ["user_id"]).select("event_id", "user_id")


@query("""
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def ingest_events(t):
    """A file stream into an idempotent log, resolved to the latest row per key."""
    source = I.stream_parquet(t.spark, f"{t.folder}/events*.parquet", t.events.schema)
    log, ckpt = scratch_path(t.spark, "log"), scratch_path(t.spark, "stream")
    pick = lambda df: df.select("user_id", "event_id", "event_type", "value", "ts")
    I.ingest_stream(source, {"events": log}, ckpt, {"events": pick}).awaitTermination()
    return I.upsert_by_key(I.read_log(t.spark, log), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""
WITH b AS (SELECT event_id, user_id, value, hour(ts) // 8 AS shift FROM events)
SELECT event_id, user_id, value FROM b QUALIFY shift = max(shift) OVER (PARTITION BY user_id)""")
def compact_log(t):
    """Batches of a log folded in two steps into a table kept by key: the rows of a user's last batch stay."""
    log, table = scratch_path(t.spark, "log"), scratch_path(t.spark, "table")
    rows = t.events.select("event_id", "user_id", "value", F.floor(F.hour("ts") / 8).alias("shift"))
    for steps in ((0, 1), (2,)):
        for shift in steps:
            rows.filter(F.col("shift") == shift).drop("shift").write.parquet(f"{log}/{I.BATCH}={shift}")
        folded = I.compact(t.spark, log, table, ["user_id"], buckets=16)
    return folded.select("event_id", "user_id", "value")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unseen_keys(t):
    """Customers without an order, told apart by filters of the stored keys and checked exactly."""
    table = scratch_path(t.spark, "orders")
    K.fold(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), table, ["c_custkey"], buckets=16)
    return K.unseen(t.customer.select("c_custkey", "c_name", "c_nationkey"), table, ["c_custkey"])


@query("SELECT doc_id, source, lang, n_chars FROM documents")
def published_documents(t):
    """A table published as a version and read back as the current one."""
    path = scratch_path(t.spark, "documents")
    publish(t.documents.limit(0), path, 1)
    publish(t.documents, path, 2)
    return read_current(t.spark, path).select("doc_id", "source", "lang", "n_chars")


@query("""
SELECT 'd' || doc_id AS show_identifier, source AS reviewer, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS comment_text, CAST(n_chars AS INTEGER) AS rating, lang AS venue
FROM documents""")
def landed_items(t):
    """Item documents landed as JSON, read by schema, their reviews and venues conformed."""
    none = F.lit(None).cast("string")
    docs = t.documents.select(
        F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("identifier"), none.alias("venue"), F.col("lang").alias("location")).alias("metadata"),
        F.array(F.struct(F.col("source").alias("username"), F.col("text").alias("reviewbody"), F.col("n_chars").alias("stars"))).alias("reviews"))
    path = scratch_path(t.spark, "items")
    docs.write.json(path)
    items = read_items(t.spark, path, multi_line=False)
    return M.normalize_reviews(items).select(SHOW, "reviewer", "comment_text", "rating").join(M.extended_metadata(items).select(SHOW, "venue"), SHOW)


@query("""
WITH a AS (SELECT text AS url, doc_id, 0 AS run FROM documents WHERE lang = 'en' UNION ALL SELECT text, doc_id, 1 FROM documents)
SELECT url, min(run) AS run FROM a GROUP BY url""")
def append_transcripts(t):
    """Transcripts appended twice over: one row per link, the stored one first."""
    rows = t.documents.select(F.col("text").alias("url"), "lang", F.lit(1).alias("run"))
    stored = rows.filter("lang = 'en'").withColumn("run", F.lit(0))
    return append_rows(stored, rows).select("url", "run")


# -- metrics ------------------------------------------------------------------
@query("""
SELECT (SELECT count(*) FROM conversations) AS comments_total, (SELECT count(DISTINCT conv_id) FROM conversations) AS shows_with_comments,
       (SELECT count(*) FROM documents) AS setlists_total, (SELECT count(*) FROM orders) AS shows_attempted""")
def corpus_metrics(t):
    """Corpus totals, from the data itself."""
    return metrics.corpus_metrics(t.conversations.select(F.col("conv_id").alias(SHOW)), t.documents, t.orders)


@query("""
WITH c AS (SELECT (SELECT count(*) FROM conversations) AS comments, (SELECT count(*) FROM documents) AS setlists, (SELECT count(*) FROM labels) AS shows)
SELECT comments, setlists, shows AS shows_processed, round(shows / 18327.0 * 100, 6) AS completion_pct,
  CAST(floor(18327.0 * comments / shows) AS BIGINT) AS estimated_comments,
  round(18327.0 * comments / shows * 100 / 1048576 + 18327 * 500 / 1048576.0, 6) AS estimated_mb,
  18327 - shows AS remaining_shows, round((18327 - shows) * 3.25 / 3600, 6) AS hours_remaining FROM c""")
def projected_totals(t):
    """Volume and time of the full collection."""
    p = metrics.project_totals(t.conversations, t.documents, t.labels)
    return p.select("comments", "setlists", "shows_processed", F.round("completion_pct", 6).alias("completion_pct"), "estimated_comments",
                    F.round("estimated_mb", 6).alias("estimated_mb"), "remaining_shows", F.round("hours_remaining", 6).alias("hours_remaining"))


@query("""
SELECT (SELECT count(*) FROM documents) AS songs_total, (SELECT count(*) FROM documents WHERE text <> '') AS with_lyrics,
  (SELECT count(*) FROM documents WHERE n_chars > 1000) AS with_notes, (SELECT count(DISTINCT doc_id) FROM labels) AS songs_done,
  (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_run""")
def harvest_progress(t):
    """Songs, lyrics, notes, look-ups done and the last run."""
    songs = t.documents.select(F.col("doc_id").alias("song"), F.col("text").alias("lyrics_text"),
                               F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("n_interpretations"))
    runs = t.orders.select(F.struct("o_orderdate", "o_orderkey").alias("started_at"), F.lit(0).alias("limit"), F.lit(0).alias("fetched"), F.lit(0).alias("skipped"))
    p = metrics.harvest_progress(songs, t.labels.select(F.col("doc_id").alias("song")), runs)
    return p.select("songs_total", "with_lyrics", "with_notes", "songs_done", F.col("last_run.started_at.o_orderkey").alias("last_run"))
