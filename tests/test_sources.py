import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from liveset.operators import metrics
from liveset.operators.format import extractive_answer
from liveset.operators.setlists import POSITION, legacy_or_rich, normalize_legacy
from liveset.plans import corpus as U
from liveset.plans.answers import answer_batch, top_with_venues
from liveset.plans.harvest import conform_items
from liveset.sources import readers, sinks
from liveset.streaming import ingest as I

SHOW = "show_identifier"


def put(path, *docs):
    path.mkdir(parents=True, exist_ok=True)
    for i, d in enumerate(docs):
        (path / f"{i:03d}.json").write_text(d if isinstance(d, str) else json.dumps(d), encoding="utf-8")
    return str(path)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


COMBINED = {
    "comments": [{"show_identifier": "gd1977-05-08.a", "comment_text": " Great show ", "reviewer": "", "rating": 5, "created": "2004-01-01"},
                 {"show_identifier": "gd1977-05-08.a", "comment_text": "  "}],
    "setlists": {
        "gd1977-05-08.a": {"sets": [{"name": "Set 1", "order": 0, "songs": [{"name": "Bertha", "duration": "7:36"}, {"name": "Bertha"}]}],
                           "songs": ["Bertha", {"name": "Eyes"}, "Space"], "transitions": [{"from": "Bertha", "to": "Eyes"}, {"from": "x", "to": ""}],
                           "guest_artists": ["Pat", ""], "date": "1977-05-08"},
        "old": ["Set I Dark Star > Morning Dew", "Encore", "Casey Jones"],
    },
    "shows_processed": ["gd1977-05-08.a", "old", "lost"],
    "deadcast_transcripts": [{"title": "T", "url": "u", "transcript": " ".join(["w"] * 501)}],
}
LYRICS = {"Ripple": {"title": "", "lyrics_text": " la ", "source_urls": ["u"], "interpretations": [{"source": "n", "text": "deep", "url": "i"}, {"source": "n", "text": " "}]},
          "bad": "not an object", "none": None}


def test_corpus_reader_to_corpus_rows(spark, tmp_path):
    t = readers.read_corpus(spark, put(tmp_path / "c", COMBINED))
    assert t["comments"].count() == 2 and t["setlists_rich"].count() == 1 and t["setlists_legacy"].count() == 1
    assert tuple(legacy_or_rich(t["setlists"]).first()) == (1, 1, 2)
    rich, legacy = U.rich_tables(t["setlists_rich"]), normalize_legacy(t["setlists_legacy"])
    lyrics = readers.read_lyrics(spark, put(tmp_path / "l", LYRICS))
    durations = readers.read_durations(spark, put(tmp_path / "d", [{"show_id": "gd1977-05-08.a", "song": "Eyes", "duration_seconds": 456.0, "duration_display": "7:36"}]))
    parts = [U.comment_rows(t["comments"]), U.setlist_song_rows(rich["songs"], ["part", "set_order", "song_no"]),
             U.setlist_song_rows(legacy["songs"], POSITION), U.guest_rows(rich["guests"]), U.transition_rows(rich["transitions"]),
             U.transition_rows(legacy["transitions"]), U.transcript_rows(t["deadcast_transcripts"]), U.duration_rows(durations),
             U.lyric_rows(lyrics), U.interpretation_rows(lyrics)]
    corpus = U.assemble_corpus(*parts)
    assert got(metrics.type_counts(corpus), "type", "n") == [
        ("comment", 1), ("deadcast_transcript", 2), ("ep_duration", 1), ("guest_artist", 1), ("interpretation", 1), ("lyric", 1), ("setlist_song", 6), ("transition", 2)]
    assert corpus.count() == sum(p.count() for p in parts)
    assert corpus.select("row_id").distinct().count() == corpus.count()
    songs = got(corpus.filter("type = 'setlist_song'").na.fill({"duration": ""}), "song_name", "duration", "created", "text")
    assert songs[0] == ("Bertha", "7:36", "1977-05-08", "Bertha - Grateful Dead setlist")
    assert {s[0] for s in songs} == {"Bertha", "Eyes", "Space", "Dark Star", "Morning Dew", "Casey Jones"}
    assert corpus.filter("type = 'comment'").first()["reviewer"] == "anonymous"
    assert corpus.filter("type = 'lyric'").first()["title"] == "Ripple"
    assert corpus.filter("type = 'ep_duration'").first()["text"] == "Eyes by Grateful Dead - 7:36 at gd1977-05-08.a"

    asked = spark.createDataFrame([(1, "song:eyes"), (2, "transition:bertha->EYES"), (3, 'guest:"pat"'), (4, "deadcast:w"), (5, "ep:"), (6, "song:none")], "question_id int, question string")
    hits = answer_batch(corpus, asked)
    assert got(hits.groupBy("question_id", "route").count(), "question_id", "route", "count") == [
        (1, "song", 1), (2, "transition", 1), (3, "guest", 1), (4, "deadcast", 2), (5, "ep", 1)]
    assert top_with_venues(durations, 5).first()["venue"] == "Boston Garden, Boston, MA"


def test_missing_files_read_empty(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert all(df.count() == 0 for df in readers.read_corpus(spark, gone).values())
    assert readers.read_lyrics(spark, gone).count() == 0 and readers.read_durations(spark, gone).count() == 0
    assert all(df.count() == 0 for df in readers.read_index(spark, gone).values())
    assert sinks.read_current(spark, gone) is None


def test_index_reader_takes_both_layouts(spark, tmp_path):
    row = {"type": "comment", "comment_text": "hi", "show_identifier": "s", "idx": 0}
    as_list = readers.read_index(spark, put(tmp_path / "a", [row, {**row, "type": "lyric"}]))
    as_object = readers.read_index(spark, put(tmp_path / "b", {"comments": [row], "lyrics": [row], "setlists": {"s": ["x"]}, "ep_durations": [{"show_id": "s", "duration_seconds": 1.5}]}))
    assert got(as_list["rows"], "type") == got(as_list["lyrics"], "type") == [("comment",), ("lyric",)]
    assert as_object["rows"].count() == as_object["lyrics"].count() == as_object["setlists"].count() == 1
    assert as_object["durations"].first()["duration_seconds"] == 1.5


ITEM = {"metadata": {"identifier": "gd1977-05-08.a", "description": "Set 1<br>Bertha, Eyes -> Space<br>Drums", "venue": "Barton", "date": "1977-05-08"},
        "files": [{"name": "gdd1t01.mp3", "title": "Bertha", "length": "5:00", "format": "VBR MP3"}, {"name": "gdd1t02.mp3", "title": "", "length": "6:00", "format": "VBR MP3"},
                  {"name": "gdd1t02.flac", "title": "", "length": "6:01", "format": "FLAC"}, {"name": "x.txt", "length": "1", "format": "FLAC"}],
        "reviews": [{"reviewidentifier": "r1", "username": None, "reviewbody": "a  great\nshow indeed", "stars": 5, "reviewdate": "2004"}]}


def test_items_to_show_tables(spark, tmp_path):
    t = conform_items(readers.read_items(spark, put(tmp_path / "i", ITEM)))
    assert got(t["songs"].na.fill(""), "song_name", "duration") == [("Bertha", "5:00"), ("Drums", ""), ("Eyes", "6:01")]
    assert got(t["transitions"], "transition_from", "transition_to") == [("Eyes", "Space")]
    assert got(t["reviews"], "reviewer", "comment_text", "is_relevant") == [("anonymous", "a great show indeed", True)]
    assert got(t["shows"], SHOW, "venue") == [("gd1977-05-08.a", "Barton")]


def test_forum_readers(spark, tmp_path):
    listing = {"data": {"children": [{"kind": "t3", "data": {"id": "p", "title": "T", "selftext": "x" * 6000, "permalink": "/r/1", "created_utc": 0}},
                                     {"kind": "t3", "data": {"id": "q", "title": ""}}]}}
    posts = readers.read_posts(spark, put(tmp_path / "p", listing), body_cap=5000)
    assert [(r.id, len(r.selftext), r.permalink, r.created, r.author) for r in posts.collect()] == [("p", 5000, "https://reddit.com/r/1", "1970-01-01", "[deleted]")]
    thread = [{"data": {"children": [{"kind": "t3", "data": {"id": "p"}}]}}, {"data": {"children": [{"kind": "t1", "data": {"id": "c", "body": "b", "replies": ""}}]}}]
    threads = readers.read_threads(spark, put(tmp_path / "t", thread))
    assert got(threads.select("id", F.size("comments").alias("n")), "id", "n") == [("p", 1)]


def test_jsonl_listing_staging_songlist(spark, tmp_path):
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(lines), "a int").count() == 2
    pages = readers.read_listing(spark, put(tmp_path / "s", {"response": {"numFound": 3, "start": 0, "docs": [{"identifier": "a"}, {"identifier": "b"}]}}))
    assert got(readers.listing_ids(pages), SHOW) == [("a",), ("b",)]
    staged = readers.read_staging(spark, put(tmp_path / "g", {"inferences": [{"song_name": "s", "plausible_singers": [{"name": "n", "tag": "t"}]}]}))
    assert got(staged, "song_name", "staged_no") == [("s", 0)]
    assert readers.read_songlist(spark, put(tmp_path / "w", {"songs": [{"name": "a", "setlist_mentions": 3}]})).first()["setlist_mentions"] == 3


def test_publish_survives_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.publish(spark.range(5), path, 1)
    broken = spark.range(3).select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception):
        sinks.publish(broken, path, 2)
    assert sinks.versions(spark, path) == [1] and sinks.read_current(spark, path).count() == 5
    sinks.publish(spark.range(7), path, 2)
    assert sinks.read_current(spark, path).count() == 7


def test_transcripts_append_once(spark):
    rows = spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, transcript string")
    more = spark.createDataFrame([("u2", "new"), ("u3", "c"), ("u3", "c")], "url string, transcript string")
    once = sinks.append_transcripts(rows, more)
    assert got(once, "url", "transcript") == [("u1", "a"), ("u2", "b"), ("u3", "c")]
    assert got(sinks.append_transcripts(once, more), "url") == [("u1",), ("u2",), ("u3",)]


def test_stream_resumes_and_replaces_by_key(spark, tmp_path, monkeypatch):
    src, ckpt = tmp_path / "landing", str(tmp_path / "ckpt")
    log = {"reviews": str(tmp_path / "log_r"), "processed": str(tmp_path / "log_p")}
    run = lambda: I.ingest_stream(I.stream_json(spark, str(src)), log, ckpt, I.item_transforms()).awaitTermination()
    reviews = lambda *texts: [{"reviewidentifier": str(i), "reviewbody": t} for i, t in enumerate(texts)]
    put(src, {"metadata": {"identifier": "s1"}, "reviews": reviews("one", "two")}, {"metadata": {"identifier": "s2"}, "reviews": reviews("x")})
    run()
    assert I.replace_by_key(I.read_log(spark, log["reviews"])).count() == 3
    (src / "100.json").write_text(json.dumps({"metadata": {"identifier": "s1"}, "reviews": reviews("only")}))
    (src / "101.json").write_text(json.dumps({"metadata": {"identifier": "s2"}, "reviews": []}))
    run()
    run()  # nothing new landed
    now = I.replace_by_key(I.read_log(spark, log["reviews"]))
    assert got(now, SHOW, "comment_text") == [("s1", "only"), ("s2", "x")]
    assert I.read_log(spark, log["processed"]).count() == 4
    table = str(tmp_path / "table")
    assert got(I.compact(spark, log["reviews"], table), SHOW) == [("s1",), ("s2",)]
    assert got(I.compact(spark, log["reviews"], table), SHOW) == [("s1",), ("s2",)]
    assert sinks.versions(spark, table) == [1]  # nothing new, nothing folded
    batch = I.batches(spark, log["reviews"])[-1] + 1
    I.read_log(spark, log["reviews"]).filter(f"{SHOW} = 's1'").drop("batch_id").withColumn("comment_text", F.lit("later")).write.parquet(f"{log['reviews']}/batch_id={batch}")
    read = []
    whole = I.read_log
    monkeypatch.setattr(I, "read_log", lambda s, p, only=None: read.append(only) or whole(s, p, only))
    assert ("s1", "later") in got(I.compact(spark, log["reviews"], table), SHOW, "comment_text")
    assert read == [[batch]] and sinks.versions(spark, table) == [1, 2]


def test_sinks(spark, tmp_path):
    out = lambda n: str(tmp_path / n)
    sinks.write_corpus(spark.range(2), out("c"))
    sinks.write_corpus(spark.range(3), out("c"), append=True)
    assert spark.read.parquet(out("c")).count() == 5
    top = spark.createDataFrame([(2, "s2", 61.0, "t", None), (1, "s1", 456.0, "u", "title")], "rank int, show_identifier string, duration_seconds double, track_file string, source string")
    sinks.write_report(metrics.ranking_lines(top), out("r"))
    assert [r.value for r in spark.read.text(out("r")).collect()] == ["| 1 | s1 | 7:36 | u | title |", "| 2 | s2 | 1:01 | t |  |"]
    lines = spark.createDataFrame([(2, "b", "edge"), (0, "0", "head"), (1, "a", "node"), (3, "", "}")], "section int, key string, value string")
    sinks.write_graph_dot(lines, out("d"))
    assert sorted(r.value for r in spark.read.text(out("d")).collect()) == ["edge", "head", "node", "}"]


def test_extractive_answer(spark):
    hits = spark.createDataFrame([(1, 1, "s", "x" * 400), (1, 2, "", "short")], "question_id int, rank int, show_identifier string, comment_text string").withColumn("type", F.lit("comment"))
    row = extractive_answer(hits).first()
    assert row.text.startswith("Based on 2 sources:\n\n**#1** — [s](https://archive.org/details/s)\nRating: N/A/5 | Date: N/A\n_" + "x" * 300 + "..._\n")
    assert "**#2** — [N/A]()" in row.text


def test_extractive_answer_holds_every_hit(spark):
    hits = spark.range(1, 31).select(F.lit(1).alias("question_id"), F.col("id").cast("int").alias("rank"), F.lit("s").alias("show_identifier"), F.lit("t").alias("comment_text"), F.lit("comment").alias("type"))
    row, first = extractive_answer(hits).first(), extractive_answer(hits, k=10).first()
    assert row.text.startswith("Based on 30 sources:") and "**#30**" in row.text
    assert first.text.startswith("Based on 10 sources:") and "**#11**" not in first.text


def test_stream_takes_new_keys_only(spark, tmp_path):
    src = put(tmp_path / "in", *[{"metadata": {"identifier": s}, "reviews": []} for s in ("a", "b", "c")])
    known = spark.createDataFrame([("a",), ("a",)], f"{SHOW} string")
    stream = I.new_keys_only(I.stream_json(spark, src).withColumn(SHOW, F.col("metadata.identifier")), known)
    log = str(tmp_path / "log")
    I.ingest_stream(stream, {"keys": log}, str(tmp_path / "ckpt"), {"keys": lambda df: df.select(SHOW)}).awaitTermination()
    assert got(I.read_log(spark, log), SHOW) == [("b",), ("c",)]


def test_tasks_need_no_installed_package(tmp_path):
    """Python work must reach executors that do not have the package on their path."""
    code = (
        "import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert e.queries()['embedded_corpus'](s, '/root/testdata/sf0.001').count() > 0\n"
        "assert e.entry(s).count() > 0\n"
    ).format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
