import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from liveset.operators import catalog as C
from liveset.operators import chunks, forum, graph
from liveset.operators import durations as D
from liveset.operators import merge as M
from liveset.operators import metrics
from liveset.operators import pages as P
from liveset.operators import review as R
from liveset.operators import search as Q
from liveset.operators import vectors as V
from liveset.operators.format import build_context
from liveset.scale import checkpoint, previous_value, row_ordinal, running_sum, shared_folder

SHOW = "show_identifier"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- durations ----------------------------------------------------------------
def test_positional_match_after_titles(spark):
    songs = frame(spark, [("s", 0, "A"), ("s", 1, "B"), ("s", 2, "C")], f"{SHOW} string, pos int, song_name string")
    tracks = frame(spark, [("s", 1, 0, "t1", "", "1"), ("s", 2, 1, "t2", "a ->", "2"), ("s", 3, 2, "t3", "Tuning", "3")],
                   f"{SHOW} string, track_no int, file_no int, track_file string, title string, length string")
    m = D.match_durations(songs, tracks, ["pos"])
    assert got(m, "song_name", "track_file") == [("A", "t2"), ("B", "t1"), ("C", "t3")]
    split = D.match_durations(songs, tracks, ["pos"], hot_rows=0)
    assert got(split, "song_name", "track_file") == got(m, "song_name", "track_file")


def test_track_best(spark):
    files = frame(spark, [("s", "d1t02.mp3", "5:00"), ("s", "d1t02.flac", "5:00"), ("s", "d1t02.ogg", "5:01"), ("s", "d2t01.mp3", None),
                          ("s", "d1t01.mp3", "x")], f"{SHOW} string, name string, length string")
    assert got(D.track_best(files), "track_no", "file_name", "duration_seconds") == [
        (1, "d1t01.mp3", None), (2, "d1t02.ogg", 301.0), (3, "d2t01.mp3", None)]


def test_song_duration_cascade(spark):
    files = frame(spark, [("a", 0, "t1", "My Song ->", "7:36"), ("a", 1, "t2", "my song", "9:00"), ("b", 0, "t1", "", "1:00"), ("b", 1, "t2", "", "3:00"),
                          ("c", 0, "t1", "my song", "0"), ("c", 1, "t2", "", "2:30"), ("c", 2, "t3", "", "1:00"), ("d", 0, "t1", "", "1:00")],
                  f"{SHOW} string, file_no int, name string, title string, length string")
    songs = frame(spark, [("b", 0, 0, "x"), ("b", 0, 1, "My Song"), ("c", 0, 0, "My Song"), ("c", 0, 1, "y")],
                  f"{SHOW} string, line_no int, item_no int, song_name string")
    shows = frame(spark, [(s,) for s in "abcd"], f"{SHOW} string")
    out = D.song_durations(shows, files, songs, "my song")
    assert got(out.na.fill({"duration_seconds": -1, "source": "none"}), SHOW, "duration_seconds", "source") == [
        ("a", 456.0, "ia_title_match"), ("b", 180.0, "positional_fallback"), ("c", 150.0, "positional_filtered"), ("d", -1.0, "none")]
    listing = frame(spark, [("d", 0, 1, "My Song"), ("b", 0, 1, "Tuning"), ("b", 1, 9, "my song")], f"{SHOW} string, listing_no int, track_number int, title string")
    out = D.song_durations(shows, files, songs, "my song", listing)
    assert got(out.filter("source like 'dead%'"), SHOW, "duration_seconds", "source") == [
        ("b", 60.0, "deadtracks_positional"), ("d", 60.0, "deadtracks_direct")]
    assert got(D.source_breakdown(out), "match_kind", "n") == [("external", 2), ("positional", 1), ("title", 1)]


def test_venues(spark):
    d = frame(spark, [("gd1977-05-08.a", 1.0, "Own"), ("gd1977-05-08.b", 3.0, None), ("gd2000-01-01.c", 2.0, ""), ("misc", 9.0, None), ("n", None, None)],
              f"{SHOW} string, duration_seconds double, venue string")
    top = D.with_venue(D.top_durations(d, 4), D.known_venues(spark))
    assert got(top, SHOW, "venue") == [("gd1977-05-08.a", "Own"), ("gd1977-05-08.b", "Boston Garden, Boston, MA"), ("gd2000-01-01.c", "Unknown venue"), ("misc", "")]


# -- merging ------------------------------------------------------------------
def test_merge_comments_first_wins_and_counts(spark):
    c = frame(spark, [("s1", "x", "f1", 0), ("s1", "x", "f2", 0), ("s1", "y", "f2", 1), (None, "x", "f2", 2)],
              f"{SHOW} string, comment_text string, file_no string, pos int")
    merged = M.merge_comments(c)
    assert got(merged, "file_no", "pos") == [("f1", 0), ("f2", 1), ("f2", 2)]
    assert M.merge_report(c, merged).first()["comments_deduplicated"] == 1
    assert got(M.merge_comments(merged), "file_no", "pos") == got(merged, "file_no", "pos")


def test_upserts(spark):
    ddl = f"{SHOW} string, comment_text string"
    old = frame(spark, [("s1", "a"), ("s1", "b"), ("s2", "c")], ddl)
    assert got(M.upsert_comments(old, frame(spark, [("s1", "n")], ddl)), SHOW, "comment_text") == [("s1", "n"), ("s2", "c")]
    assert M.upsert_comments(old, frame(spark, [], ddl)).count() == 3
    decisions = frame(spark, [("x", "approved", "2024-01-01"), ("x", "rejected", "2024-02-01")], "song_name string, status string, decided_at string")
    assert got(M.apply_decisions(decisions), "status") == [("rejected",)]


def test_year_needs_every_page(spark):
    pages = frame(spark, [(1977, 100, 150), (1977, 50, 150), (1978, 100, 150)], "year int, items_read int, num_found int")
    assert got(M.year_status(pages), "year", "complete") == [(1977, True), (1978, False)]


def test_backfill_keeps_existing_and_processed_only(spark):
    p = frame(spark, [("a",), ("b",)], f"{SHOW} string")
    old = frame(spark, [("a", "old"), ("z", "old")], f"{SHOW} string, v string")
    new = frame(spark, [("a", "new"), ("b", "new"), ("y", "new")], f"{SHOW} string, v string")
    assert got(M.backfill(p, old, new), SHOW, "v") == [("a", "old"), ("b", "new")]


def test_progress_reports_data(spark):
    songs = frame(spark, [("a", "text", 1), ("b", None, 0)], "song string, lyrics_text string, n_interpretations int")
    runs = frame(spark, [("2024-01", 5, 1, 0), ("2024-02", 6, 2, 1)], "started_at string, `limit` int, fetched int, skipped int")
    row = metrics.harvest_progress(songs, frame(spark, [("a",), ("a",)], "song string"), runs).first()
    assert (row.songs_total, row.with_lyrics, row.with_notes, row.songs_done, row.last_run.started_at) == (2, 1, 1, 1, "2024-02")


def test_projection_without_processed_shows(spark):
    none = frame(spark, [], "x int")
    assert metrics.project_totals(none, none, none).first()["estimated_comments"] == 18327 * 5


# -- catalogue ----------------------------------------------------------------
def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(7)
    left = ["".join(rng.choice("abc de") for _ in range(rng.randint(1, 25))).strip() or "a" for _ in range(40)]
    right = list({x for w in left for x in (w, w[:-1] or w, w + "x", w[: len(w) // 2] + "q" + w[len(w) // 2:], w[1:] + "zz")})
    best = {}
    for w in set(left):
        scored = [(SequenceMatcher(None, c, w).ratio(), c) for c in right if c]
        top = max(scored)
        if top[0] >= 0.9:
            best[w] = (top[1], round(top[0], 9))
    out = C.fuzzy_match(frame(spark, [(w,) for w in left], "left_key string"), frame(spark, [(w,) for w in right], "right_key string"))
    assert {r.left_key: (r.right_key, round(r.ratio, 9)) for r in out.collect()} == best


def test_fuzzy_fixture(spark):
    out = C.fuzzy_match(frame(spark, [("playing in band",), ("abcde",)], "left_key string"), frame(spark, [("playin in band",), ("abcd",)], "right_key string"))
    assert [(r.left_key, round(r.ratio, 4)) for r in out.collect()] == [("playing in band", 0.9655)]


def test_match_canonical_exact_alias_fuzzy(spark):
    index = frame(spark, [("dark star", "dark-star"), ("iko iko", "iko"), ("sugar magnolia", "sugar")], "song_key string, slug string")
    songs = frame(spark, [("Dark Star", 3), ("I Ko I Ko", 2), ("Sugar Magnollia", 5), ("Nothing", 1)], "name string, setlist_mentions bigint")
    m = C.match_canonical(songs, index)
    assert got(m.filter("slug is not null"), "name", "slug", "match") == [
        ("Dark Star", "dark-star", "exact"), ("I Ko I Ko", "iko", "exact"), ("Sugar Magnollia", "sugar", "fuzzy")]
    roll = C.canonical_mentions(m, index.union(frame(spark, [("x", "never-played")], "k string, s string")))
    assert got(roll, "slug", "name", "setlist_mentions") == [
        ("dark-star", "Dark Star", 3), ("iko", "I Ko I Ko", 2), ("never-played", "Never Played", 0), ("sugar", "Sugar Magnollia", 5)]


def test_song_mentions_drop_noise(spark):
    df = frame(spark, [("1. Ripple [7:52]",), ("Ripple",), ("tuning",), ("Bob - Guitar",), ("d2t01 - Bertha",), (" ",)], "song_name string")
    assert got(C.song_mentions(df), "name", "setlist_mentions") == [("Bertha", 1), ("Ripple", 2)]


def test_next_songs_counts_recorded_misses(spark):
    corpus = frame(spark, [("A", 5), ("B", 4), ("C", 9)], "name string, setlist_mentions bigint")
    done = frame(spark, [("C", "x"), ("C", "y"), ("A", "x")], "name string, source string")
    assert [r["name"] for r in C.next_songs(corpus, done, ["x", "y"], 5).collect()] == ["A", "B"]


def test_merge_song_entries(spark):
    ddl = ("song string, priority int, title string, url string, lyricists array<string>, music_by array<string>, lyrics_text string, "
           "interpretations array<struct<source:string,text:string,url:string,date:string>>, first_played_hint string")
    rows = [("s", 1, "T1", "http://a/1", ["P"], [], "12345", [("n", "t", "u", None)], None),
            ("s", 2, "T2", "http://b/2", ["P", "Q"], ["M"], "123456789", [("n", "t", "u2", None), ("n", "t2", "u", None)], "1970"),
            ("s", 3, "T3", "http://b/jam#x", ["Z"], [], "way too long to be right", [("n", "no", "u", None)], None)]
    t = C.merge_song_entries(frame(spark, rows, ddl))
    assert got(t["songs"], "title", "lyrics_text", "first_played_hint") == [("T1", "123456789", "1970")]
    assert got(t["credits"], "kind", "credit") == [("lyricist", "P"), ("lyricist", "Q"), ("music", "M")]
    assert got(t["links"], "url") == [("http://a/1",), ("http://b/2",), ("http://b/jam#x",)]
    assert got(t["interpretations"], "text", "interpretation_url") == [("t", "u"), ("t2", "u")]


def test_posts_for_songs_whole_words(spark):
    songs = frame(spark, [("Dark Star",), ("Eyes",), ("Ann",)], "song_name string")
    posts = frame(spark, [(1, "Dark Star Song Discussion", "b" * 700, "u1", "d"), (2, "darkstar eyes", "", "u2", "d"), (3, "Eyesight", "", "u3", "d")],
                  "n int, title string, text string, url string, created string")
    out = C.posts_for_songs(songs, posts, ["n"])
    assert got(out, "song_name", "url") == [("Dark Star", "u1"), ("Eyes", "u2")]
    assert len(out.filter("url = 'u1'").first()["text"]) == len("Dark Star Song Discussion -- ") + 600


# -- texts --------------------------------------------------------------------
def test_chunk_words(spark):
    df = frame(spark, [(1, " ".join(str(i) for i in range(1201))), (2, "  ")], "id int, t string")
    assert got(chunks.chunk_words(df, "t"), "id", "chunk_index", "word_count") == [(1, 0, 500), (1, 1, 500), (1, 2, 201)]


def split_by_hand(text, limit):
    out = []
    while len(text) > limit:
        at = text.rfind("\n", 0, limit)
        at = limit if at < limit // 2 else at
        out.append(text[:at])
        text = text[at:].lstrip("\n")
    return out + ([text] if text else [])


def test_split_text_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["abcd\nefghij\nkl", "abcdefg\nhij\nkl", "", "\n" * 30] + ["".join(rng.choice("ab\n") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    df = frame(spark, list(enumerate(texts)), "id int, t string")
    parts = {}
    for r in chunks.split_text(df, "t", 10).orderBy("id", "part_no").collect():
        parts.setdefault(r.id, []).append(r.part)
    assert [parts.get(i, []) for i in range(len(texts))] == [split_by_hand(t, 10) for t in texts]


def test_posts(spark):
    df = frame(spark, [(1, "Review of the show", ""), (2, "1977-05-08 setlist", ""), (3, "Hi", ""), (4, "Hi", "my favorite thoughts")], "id int, title string, selftext string")
    assert got(forum.classify_posts(df), "id", "categories") == [(1, ["review"]), (2, ["setlist", "show_thread"]), (3, ["general"]), (4, ["review", "song"])]


def test_messages_and_routes(spark):
    df = frame(spark, [('!gd lyrics Ripple',), ('meaning "Dark Star"',), ("hello there",), ("!gd",), ("SEARCH a\nb",)], "text string")
    assert [tuple(r)[1:] for r in forum.parse_messages(df).collect()] == [
        ("lyrics", "Ripple"), ("meaning", "Dark Star"), ("ask", "hello there"), ("ask", ""), ("search", "a\nb")]
    df = frame(spark, [('song:"Eyes"',), ("transition:a -> b",), ("transition:a->b->c",), ("ep:",), ("who",), ("guest:Duane",)], "question string")
    assert [tuple(r)[1:] for r in forum.route_questions(df).collect()] == [
        ("song", "Eyes", None), ("transition", "a", "b"), ("transition", "a->b->c", None), ("ep", "", None), ("vector", "who", None), ("guest", "Duane", None)]


def test_flatten_replies_depth_order_cap(spark):
    import json

    def node(i, *kids, kind="t1"):
        return {"kind": kind, "data": {"id": i, "body": i * 2100, "author": None, "score": 1, "created_utc": 1.0,
                                       "replies": {"data": {"children": list(kids)}} if kids else ""}}
    tree = [node("a", node("b", node("c", node("d", node("e")))), node("m", kind="more")), node("f")]
    raw = frame(spark, [(1, json.dumps(tree))], "id int, j string")
    posts = raw.select("id", F.transform(F.from_json("j", "array<string>"), lambda s: F.from_json(s, forum.NODE)).alias("comments"))
    out = forum.flatten_replies(posts.withColumnRenamed("id", "post_id"))
    assert got(out, "comment_no", "id", "depth", "author") == [(0, "a", 0, "[deleted]"), (1, "b", 1, "[deleted]"), (2, "c", 2, "[deleted]"), (3, "d", 3, "[deleted]"), (4, "f", 0, "[deleted]")]
    assert len(out.first()["body"]) == 2100
    assert len(forum.flatten_replies(posts.withColumnRenamed("id", "post_id"), body_cap=2000).first()["body"]) == 2000
    assert forum.flatten_replies(posts.withColumnRenamed("id", "post_id"), cap_rows=2).count() == 2


# -- pages --------------------------------------------------------------------
FIELDS_PAGE = """<title>Ripple | Site</title><div class="z field--name-body">chrome { { { sign up here for all of the newsletters we have</div>
<div class="node__content"><div class="c field--name-body field">get on the list please, it is a very long notice indeed</div>
<div class="c field--name-body field"><style>x{}</style><p>(1) A note</p><p>Too short</p><p>This one is long &amp; fine <b>now</b></p>
<div class="c field--name-field-lyrics-by x"><div class="field__item">Robert Hunter (note a)</div><div class="field__item"> </div></div>
<div class="c field--name-field-lyrics x"><div class="field__label">Lyrics</div>If my words<br/>did glow &amp; more  \n\n\n\nend</div></article>
<p>It was first played on 18 August 1970 there</p>"""


def test_song_pages_fields(spark):
    t = P.extract_song_pages_a(frame(spark, [("ripple", FIELDS_PAGE), ("bare", "<p>x</p>")], "slug string, html string"))
    song = t["songs"].filter("slug = 'ripple'").first()
    assert (song.title, song.lyricists, song.music_by, song.first_played_hint) == ("Ripple", ["Robert Hunter"], [], "18 August 1970")
    assert song.lyrics_text == "If my words\ndid glow & more\n\nend"
    bare = t["songs"].filter("slug = 'bare'").first()
    assert (bare.title, bare.lyrics_text, bare.lyricists) == ("bare", "", [])
    assert got(t["interpretations"], "text") == [("(1) A note",), ("This one is long & fine now",)]


PLAIN_PAGE = """<html><title>Ripple</title><body>Ripple<br>
Lyrics: Hunter, A & B and C (note x)
Music: Garcia
<p>line one<br>line two</p>
Notes
(a) first note here
goes on
(b) short
(c) another long note
Grateful Dead Recordings
Date</body></html>"""


def test_song_pages_plain(spark):
    t = P.extract_song_pages_b(frame(spark, [("u", PLAIN_PAGE), ("i", "Music: X\n(instrumental)\nNotes\n")], "url string, html string"))
    song = t["songs"].filter("url = 'u'").first()
    assert (song.title, song.lyricists, song.music_by) == ("Ripple", ["Hunter", "A", "B", "C"], ["Garcia"])
    assert song.lyrics_text == "line one\nline two"
    assert t["songs"].filter("url = 'i'").first().lyrics_text == ""
    assert got(t["interpretations"].filter("url = 'u'"), "text") == [("(a) first note here goes on",), ("(c) another long note",)]


def test_links_indexes_transcripts(spark):
    html = ('<a href="/episodes/1">One</a> <a href="/episodes/1">Again</a> <a href="/x">no</a> <a class="k" href="http://o/Episode2"><b>Two</b></a>'
            '<a href="mailto:x@h">m</a><div class="a transcript b">Hello &amp; <i>bye</i></div>')
    pages = frame(spark, [("https://h/p", html)], "url string, html string")
    assert got(P.extract_links(pages), "url", "title") == [("http://o/Episode2", "Two"), ("https://h/episodes/1", "One")]
    assert got(P.extract_page_links(pages), "target") == [("https://h/episodes/1",), ("https://h/episodes/1",), ("https://h/x",)]
    assert got(P.extract_transcripts(pages), "transcript", "word_count") == [("Hello & bye", 3)]
    index = frame(spark, [("p", '<a href="/song/a">Dark Star</a><a href="/song/b">The Dark Star</a>')], "url string, html string")
    pattern = r'href="(/song/[^"#?]+)"[^>]*>(.*?)</a>'
    assert got(P.extract_title_index(index, pattern), "song_key", "slug") == [("dark star", "b")]
    assert got(P.extract_title_index(index, pattern, first_wins=True, base="http://s"), "song_key", "slug") == [("dark star", "http://s/song/a")]
    table = frame(spark, [("u", "<table><tr><td>1</td><td>A &gt;</td></tr><tr><th>x</th><td>B</td></tr><tr><td>1</td><td>C</td></tr><tr><td>2</td><td>D</td><td>E</td></tr></table>")], "url string, html string")
    assert got(P.extract_track_table(table), "track_number", "title") == [(1, "C")]


# -- graph --------------------------------------------------------------------
def test_bfs_fixture_and_tree(spark):
    edges = frame(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "a")], "source string, target string")
    levels = graph.bfs(edges, frame(spark, [("a",)], "node string"))
    assert got(levels, "node", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert got(graph.tree_edges(levels), "source", "target") == [("a", "b"), ("a", "c"), ("c", "d")]
    assert graph.bfs(edges, frame(spark, [("a",)], "node string"), 1).count() == 3
    assert got(graph.degrees(graph.tree_edges(levels)), "url", "in_degree", "out_degree") == [("a", 0, 2), ("b", 1, 0), ("c", 1, 1), ("d", 1, 0)]


def test_dot_lines(spark):
    nodes = frame(spark, [("https://h/", 0), ("https://h", 1), ("https://h/a/b", 30)], "url string, depth int")
    lines = graph.graph_dot_lines(nodes, frame(spark, [("https://h/", "https://h/a/b")], "source string, target string"), "g", "https://h")
    assert [r.value for r in lines.orderBy("section", "key").collect()] == [
        "digraph g {", "  rankdir=TB;", "  node [shape=box, style=filled];", '  "https://h" [label="/", fillcolor="lightgreen"];',
        '  "https://h/" [label="/\\n", fillcolor="lightblue"];', '  "https://h/a/b" [label="/\\na/\\nb", fillcolor="lightgoldenrodyellow"];',
        '  "https://h/" -> "https://h/a/b";', "}"]


# -- review -------------------------------------------------------------------
def test_review(spark):
    staging = frame(spark, [("a", None), ("b", "approved"), ("c", "weird"), ("d", "pending")], "song_name string, status string")
    queue = R.review_queue(staging, frame(spark, [("d", "rejected")], "song_name string, status string"))
    assert got(queue, "song_name", "status", "status_rank") == [("a", "pending", 0), ("b", "approved", 1), ("c", "weird", 0), ("d", "rejected", 2)]
    assert R.review_page(queue, ["song_name"], page=9).count() == 1
    assert dict(got(metrics.status_counts(staging.limit(0)), "status", "n")) == {"pending": 0, "approved": 0, "rejected": 0}


def test_promote_several_tags(spark):
    lyrics = frame(spark, [("A", "la"), ("B", "[Bob] x"), ("C", None)], "title string, lyrics_text string")
    wanted = frame(spark, [("A", "", "Bob"), ("A", "", "Jerry"), ("x", "B", "Bob"), ("C", "gone", "Bob"), ("zz", "", "Bob")], "song_name string, canonical_title string, tag string")
    updated, errors = R.promote_tags(lyrics, wanted)
    assert got(updated, "title", "lyrics_text") == [("A", "[Jerry]\n\n[Bob]\n\nla"), ("B", "[Bob] x"), ("C", "[Bob]\n\n")]
    assert got(errors, "song_name", "error") == [("x", "already tagged"), ("zz", "song not found")]


def test_promotions_without_tag_and_in_decision_order(spark):
    lyrics = frame(spark, [("A", "la")], "title string, lyrics_text string")
    wanted = frame(spark, [("A", "", "Zed", "2024-01-01"), ("A", "", "Bob", "2024-01-02"), ("A", "", "Zed", "2024-01-03"), ("A", "", None, "1"), ("A", "", "", "1")],
                   "song_name string, canonical_title string, tag string, decided_at string")
    updated, errors = R.promote_tags(lyrics, wanted)
    assert got(updated, "lyrics_text") == [("[Bob]\n\n[Zed]\n\nla",)]
    assert sorted((str(r.tag), r.error) for r in errors.collect()) == [("", "no tag"), ("None", "no tag")]


# -- vectors and search -------------------------------------------------------
def test_knn_paths_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8)).astype("float32")
    corpus = np.concatenate([base, base[:20]])  # copies tie exactly
    asked = rng.normal(size=(7, 8)).astype("float32")
    c = frame(spark, [(i, v.tolist()) for i, v in enumerate(corpus)], "row_id int, embedding array<float>").repartition(5)
    q = frame(spark, [(i, v.tolist()) for i, v in enumerate(asked)], "question_id int, embedding array<float>")
    d = ((corpus[None].astype("float64") - asked[:, None].astype("float64")) ** 2).sum(-1)
    want = sorted((qi, int(ri), r + 1) for qi in range(7) for r, ri in enumerate(np.lexsort((np.arange(80), d[qi]))[:9]))
    assert got(V.knn(c, q, 9), "question_id", "row_id", "rank") == want
    assert got(V.knn(c, q, 9, max_questions=2, grid_rows=13), "question_id", "row_id", "rank") == want
    one = [r for n in range(7) for r in got(V.knn(c, q.filter(f"question_id = {n}"), 9), "question_id", "row_id", "rank")]
    assert sorted(one) == want
    assert V.knn(c, q.limit(0), 3).count() == 0


@pytest.mark.parametrize("norm", [1.0, 1e3, 1e6])
def test_knn_is_exact_at_any_norm(spark, norm):
    rng = np.random.default_rng(7)
    corpus = norm + rng.normal(scale=1e-3, size=(200, 8))
    corpus = np.concatenate([corpus, corpus[:30]])
    asked = norm + rng.normal(scale=1e-3, size=(4, 8))
    c = frame(spark, [(f"r{i:03d}", v.tolist()) for i, v in enumerate(corpus)], "row_id string, embedding array<double>").repartition(3)
    q = frame(spark, [(i, v.tolist()) for i, v in enumerate(asked)], "question_id int, embedding array<double>")
    d = ((corpus[None] - asked[:, None]) ** 2).sum(-1)
    want = sorted((i, f"r{r:03d}", n + 1) for i in range(4) for n, r in enumerate(np.lexsort((np.arange(230), d[i]))[:9]))
    assert got(V.knn(c, q, 9), "question_id", "row_id", "rank") == want
    assert got(V.knn(c, q, 9, max_questions=2, grid_rows=50), "question_id", "row_id", "rank") == want


def test_nested_transcripts_and_decoded_credits(spark):
    pages = frame(spark, [
        ("nested", '<div class="x"><div class="transcript big"><div>one</div><div>two <div>deep</div></div></div>after</div>'),
        ("open", '<div class="transcript">never <b>closed</b>'),
        ("empty", '<div class="transcript"></div><div id="transcript-content">other</div><p>' + "long paragraph " * 5 + "</p>"),
    ], "url string, html string")
    out = {r.url: r.transcript for r in P.extract_transcripts(pages).collect()}
    assert out == {"nested": "onetwo deep", "open": "never closed", "empty": ("long paragraph " * 5).strip()}
    song = frame(spark, [("s", '<div class="field--name-field-lyrics-by"><div class="field__item">Hunter &amp; Garcia (note a)</div><div class="field__item"> </div></article>')], "slug string, html string")
    assert P.extract_song_pages_a(song)["songs"].first()["lyricists"] == ["Hunter & Garcia"]


def test_digest_keeps_first_prompt(spark):
    c = frame(spark, [(1, [0.0]), (2, [5.0])], "row_id int, embedding array<float>")
    q = frame(spark, [(1, [1.0]), (2, [0.0])], "question_id int, embedding array<float>")
    assert got(V.digest(c, q, 1), "row_id", "question_id", "score") == [(1, 1, 1.0)]


def test_lyric_scores_equal_brute_force(spark):
    names = ["China Cat Sunflower", "Morning Star", "Dark Star", "Ripple", "Rip", "a", "The Other One"]
    asked = ["China Cat", "dark star jam", "ripple!", "the one other", "", "zzz", "a"]
    norm = lambda s: "".join(ch for ch in s.lower() if ch.isalnum() or ch == " ").strip()
    want = []
    for i, q in enumerate(map(norm, asked)):
        for n in names:
            nm, words = norm(n), set(q.split())
            score = 1.0 if nm == q else 0.8 if q and (q in nm or nm in q) else 0.5 * len(words & set(nm.split())) / max(len(words), len(nm.split()), 1)
            if score > 0:
                want.append((i, n, round(score, 4)))
    out = Q.lyric_scores(frame(spark, [(n,) for n in names], "song_name string"), frame(spark, list(enumerate(asked)), "question_id int, question string"))
    assert got(out.withColumn("score", F.round("score", 4)), "question_id", "song_name", "score") == sorted(want)


def test_substring_hits_both_ways(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abC d") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    terms = sorted({"".join(rng.choice("abc d") for _ in range(rng.randint(1, 12))) for _ in range(40)} | {"a", "b "})
    want = sorted((i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in t.lower())
    df, tq = frame(spark, list(enumerate(texts)), "id int, t string"), frame(spark, list(enumerate(terms)), "question_id int, term string")
    assert got(Q.substring_hits(df, tq, "t"), "id", "question_id") == want
    assert got(Q.substring_hits(df, tq, "t", max_terms=3), "id", "question_id") == want
    empty = frame(spark, [(1, ""), (2, None)], "question_id int, term string")
    every = sorted((i, 1) for i in range(len(texts)))
    assert got(Q.substring_hits(df, empty, "t"), "id", "question_id") == every == got(Q.substring_hits(df, empty, "t", max_terms=0), "id", "question_id")


def test_hybrid_and_context(spark):
    c = frame(spark, [(1, [0.0], "gd1977-05-08.a"), (2, [9.0], "gd78-05-08.b"), (3, [8.0], "misc")], f"row_id int, embedding array<float>, {SHOW} string").withColumn(
        "type", F.lit("comment")).withColumn("created", F.lit("")).withColumn("comment_text", F.lit("hello"))
    q = frame(spark, [(1, [0.0], "5/8"), (2, [9.0], "no date")], "question_id int, embedding array<float>, question string")
    hits = Q.hybrid_search(c, q, 1, F.to_date(F.lit("2024-01-01")))
    assert got(hits, "question_id", "row_id", "score_kind", "rank") == [(1, 1, "distance", 1), (1, 2, "date", 2), (2, 2, "distance", 1)]
    text = {r.question_id: r.text for r in build_context(hits.join(c, "row_id")).collect()}
    assert text[1] == ("[1] gd1977-05-08.a — https://archive.org/details/gd1977-05-08.a\nhello\n\n"
                       "[2] gd78-05-08.b — https://archive.org/details/gd78-05-08.b\nhello")
    # Ranks may be of any size, and lines beyond k are cut before they are gathered.
    late = hits.join(c, "row_id").withColumn("rank", F.col("rank") + 5000)
    assert {r.question_id: (r.text[:6], r.n_sources) for r in build_context(late, k=1).collect()} == {1: ("[5001]", 1), 2: ("[5001]", 1)}
    rated = hits.join(c, "row_id").withColumn("rating", F.lit(0))
    assert "rating" not in build_context(rated).first()["text"] and "(rating 0/5)" in build_context(rated.withColumn("rating", F.lit("0"))).first()["text"]


# -- scale helpers ------------------------------------------------------------
def test_hot_keys_give_the_same_results(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("p"), (F.col("id") % 4).alias("v"))
    plain = running_sum(df, ["k"], ["p"], "v", "s")
    split = running_sum(df, ["k"], ["p"], "v", "s", hot_rows=200)
    assert plain.count() == split.count() == 3000  # a null key is kept, and is the hot one here
    assert got(plain, "p", "s") == got(split, "p", "s")
    assert got(row_ordinal(df, ["k"], ["p"], "n"), "p", "n") == got(row_ordinal(df, ["k"], ["p"], "n", hot_rows=200), "p", "n")
    lag = lambda **kw: previous_value(df, ["k"], ["p"], "v", "b", **kw).na.fill(-1)
    assert got(lag(), "p", "b") == got(lag(hot_rows=200), "p", "b")


def test_checkpoint_uses_the_session_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert checkpoint(spark.range(3)).count() == 3
