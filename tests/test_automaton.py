"""Automata, term batches, first rows with totals and title cutting against brute force."""

import random
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from liveset.functions import automaton as A
from liveset.operators import search as Q
from liveset.operators import setlists as S
from liveset.plans.answers import answer_batch, with_rows
from liveset.queries import load


def random_text(rng, letters, most):
    return "".join(rng.choices(letters, k=rng.randint(0, most)))


@pytest.mark.parametrize("span", [3, 7, 1024])
@pytest.mark.parametrize("cells", [10, 1 << 24])
def test_automaton_equals_brute_force(monkeypatch, span, cells):
    monkeypatch.setattr(A, "SPAN", span)
    rng = random.Random(span * cells)
    for _ in range(60):
        letters = rng.choice(["ab", "abc", "aé b"])
        terms = sorted({random_text(rng, letters, 4) + rng.choice(letters) for _ in range(rng.randint(1, 12))})
        texts = [None if rng.random() < 0.1 else random_text(rng, letters, 40) for _ in range(8)]
        data, offsets = A.bytes_of(pa.array(texts, pa.string()))
        found, places = set(), set()
        for at, one in A.automata([t.encode() for t in terms], cells):
            text, term = one.find(data, offsets)
            found |= {(int(i), int(at[k])) for i, k in zip(text, term)}
            places |= {(int(i), int(b), int(e), int(at[k])) for i, b, e, k in one.occurrences(data, offsets)}
        raw = [(t or "").encode() for t in texts]
        want = {(i, b, b + len(t.encode()), k) for i, x in enumerate(raw) for k, t in enumerate(terms)
                for b in range(len(x)) if x[b:].startswith(t.encode())}
        assert places == want
        assert found == {(i, k) for i, _, _, k in want}


def test_long_texts_many_terms_and_none():
    words = [f"w{i}x" for i in range(5000)]
    data, offsets = A.bytes_of(pa.array(["", " ".join(words), None]))
    ((places, one),) = A.automata([w.encode() for w in words])
    text, term = one.find(data, offsets)
    assert sorted(places[term]) == list(range(5000)) and set(text) == {1}
    assert A.automata([]) == [] and len(one.find(*A.bytes_of(pa.array([], pa.string())))[0]) == 0


def test_substring_hits_three_ways(spark):
    rng = random.Random(3)
    texts = [(i, None if i % 11 == 0 else random_text(rng, "aBé b", 30), [i, 2]) for i in range(200)]
    terms = [(i, None if i % 13 == 0 else random_text(rng, "aBé b", 3)) for i in range(60)]
    df = spark.createDataFrame(texts, "id int, t string, extra array<int>").repartition(5)
    asked = spark.createDataFrame(terms, "question_id int, term string")
    want = sorted((i, q, tuple(e)) for i, t, e in texts for q, x in terms if x is not None and x.lower() in (t or "").lower())

    def got(**kw):
        return sorted((r["id"], r["question_id"], tuple(r["extra"])) for r in Q.substring_hits(df, asked, "t", **kw).collect())

    assert got() == got(max_terms=1000) == got(max_terms=0, max_bytes=0) == want
    plan = Q.substring_hits(df, asked, "t")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[1].replace("RoundRobin", "") or "Generate" not in plan.split("Physical Plan")[1]


def test_first_with_total_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.5, -1.0]), i) for i in range(500)] + [("hot", 1.0, i) for i in range(500, 1500)]
    df = spark.createDataFrame(rows, "question string, score double, id int").repartition(7)
    got = {(r["question"], r["id"], r["rank"], r["total"]) for r in Q.first_with_total(
        df, ["question"], [("score", "descending"), ("id", "ascending")], 3, held_rows=20).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {(key, r[2], n, len(own)) for n, r in enumerate(own[:3], 1)}
    assert got == want
    assert Q.first_with_total(df.filter("id < 0"), ["question"], [("id", "ascending")], 3).count() == 0


def test_long_lists_are_numbered_by_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.5, -1.0]), i) for i in range(300)] + [("hot", 1.0, i) for i in range(300, 900)]
    df = spark.createDataFrame(rows, "question string, score double, id int").repartition(7)
    order = [("score", "descending"), ("id", "ascending")]
    for k in (250, 10**9):
        # Lists that a task may hold, then lists that it may not, in one range a key and in several.
        want, *got = [sorted(Q.first_with_total(df, ["question"], order, k, **kw).select("question", "id", "score", "rank", "total").collect(), key=str)
                      for kw in ({"held_rows": 10**9}, {"held_rows": 100}, {"held_rows": 100, "hot_rows": 50})]
        assert got == [want, want] and len(want) == (900 - 350 if k == 250 else 900)
        assert Q.first_with_total(df, ["question"], order, k, held_rows=100).schema["rank"].dataType.typeName() == "integer"
    assert Q.first_with_total(df.filter("id < 0"), ["question"], order, 250, held_rows=100).count() == 0


def test_few_terms_are_asked_where_texts_are_read(spark):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("Song "), F.col("id").cast("string")).alias("t"), F.md5(F.col("id").cast("string")).alias("digest"))
    asked = spark.createDataFrame([(1, "SONG 7"), (2, "9"), (3, None)], "question_id int, term string")
    hits = Q.substring_hits(df, asked, "t")
    assert {(r["id"], r["question_id"]) for r in hits.collect()} == {(i, 1) for i in [7, *range(70, 80)]} | {(i, 2) for i in range(100) if "9" in str(i)}
    lines = hits._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda what: [i for i, x in enumerate(lines) if what in x][-1]
    assert at("Filter") > at("md5(")  # deeper in the plan: digests of hits only


def test_hits_bring_columns_along(spark):
    corpus = spark.createDataFrame(
        [(f"r{i // 2}", "setlist_song", "Dark Star", None, None, None, f"said {i // 2}") for i in range(6)] + [("e", "ep_duration", "Dark Star", None, None, None, "x")],
        "row_id string, type string, song_name string, guest_artist string, transition_from string, transition_to string, comment_text string"
    ).withColumn("text", F.lit(None).cast("string")).withColumn("duration_seconds", F.lit(1.0))
    asked = spark.createDataFrame([(1, 'song:"dark"'), (2, "ep:")], "question_id int, question string")
    for most in (4, 10**9):
        hits = answer_batch(corpus, asked, limits={"song": most}, keep=["comment_text"]).collect()
        assert sorted((r["row_id"], r["comment_text"], r["total"]) for r in hits if r["route"] == "song") == [
            (f"r{i // 2}", f"said {i // 2}", 6) for i in range(min(most, 6))]
        assert [r["row_id"] for r in hits if r["route"] == "ep"] == ["e"]


def test_hits_of_every_route_bring_columns_along(spark):
    corpus = spark.createDataFrame(
        [("s", "setlist_song", "Dark Star", None, None, "said s", None), ("e", "ep_duration", "Dark Star", 9.0, None, "said e", None), ("f", "ep_duration", "Jam", 7.0, None, "said f", None)]
        + [(f"v{i // 2}", "book_chunk", None, None, [float(i // 2), 0.0], f"said v{i // 2}", i) for i in range(8)] + [(None, "book_chunk", None, None, [0.0, 9.0], "no id", 9)],
        "row_id string, type string, song_name string, duration_seconds double, embedding array<double>, comment_text string, position int"
    ).select("*", *[F.lit(None).cast("string").alias(c) for c in ("guest_artist", "transition_from", "transition_to", "text")])
    asked = spark.createDataFrame([(1, "song:dark", None), (2, "ep:", None), (3, "plain", [0.0, 0.0]), (4, "guest:dark", None)], "question_id int, question string, embedding array<double>")
    hits = answer_batch(corpus, asked, limits={"vector": 4}, keep=["comment_text"]).collect()
    assert sorted((r["question_id"], r["route"], r["rank"], r["row_id"], r["comment_text"]) for r in hits) == [
        (1, "song", 1, "s", "said s"), (2, "ep", 1, "e", "said e"), (2, "ep", 2, "f", "said f"),
        (3, "vector", 1, "v0", "said v0"), (3, "vector", 2, "v0", "said v0"), (3, "vector", 3, "v1", "said v1"), (3, "vector", 4, "v1", "said v1")]


def test_rows_of_few_hits_are_found_without_exchanging_the_corpus(spark):
    corpus = spark.range(3000).select(F.concat(F.lit("r"), (F.col("id") % 1000).cast("string")).alias("row_id"), (F.col("id") % 1000).alias("n"))
    hits = spark.createDataFrame([(1, "r7"), (1, "r7"), (2, "r9"), (2, "gone"), (3, None)], "question_id int, row_id string")
    set_to = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the hits were not known to be few
    try:
        shown = with_rows(hits, corpus)
        assert sorted(tuple(r) for r in shown.collect()) == [("r7", 1, 7), ("r7", 1, 7), ("r9", 2, 9)]
        semi = [x for x in shown._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftSemi" in x]
        assert len(semi) == 1 and "BroadcastHashJoin" in semi[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", set_to)


def test_conditions_on_hits_hold_by_all_three_ways(spark):
    df = spark.range(200).select(F.col("id"), F.concat(F.lit("Song "), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("kind"))
    asked = spark.createDataFrame([((1, 0), "SONG 7"), ((2, 1), "9"), ((3, 2), ""), ((4, None), "9"), ((5, 1), "9")], "question_id struct<n: int, kind: int>, term string")
    want = sorted((i, q) for i in range(200) if i % 5 for q, kind, term in ((1, 0, "song 7"), (2, 1, "9"), (3, 2, ""), (5, 1, "9")) if term in f"song {i}" and i % 3 == kind)
    for ways in ({}, {"max_terms": 1}, {"max_terms": 1, "max_bytes": 0}):
        hits = Q.substring_hits(df, asked, "t", keep=["id", "kind"], where=lambda q: q["kind"] == F.col("kind"), **ways)
        assert sorted((r["id"], r["question_id"]["n"]) for r in hits.collect()) == want


def test_a_ranked_batch_stores_no_corpus(spark, tmp_path):
    """The corpus is many times as large as the tables it is made of: neither it nor its rows of the
    route types are written down or exchanged, only hits."""
    lines, parts = 3000, 30
    tables = {
        "lineitem": spark.range(lines).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 + 1 AS int) AS l_linenumber", f"id % {parts} AS l_partkey", "id % 7 AS l_suppkey",
                                                  "cast(id % 50 + 1 AS double) AS l_quantity", "cast(id AS double) AS l_extendedprice",
                                                  "CASE id % 3 WHEN 0 THEN 'R' ELSE 'N' END AS l_returnflag", "CASE id % 2 WHEN 0 THEN 'F' ELSE 'O' END AS l_linestatus"),
        "part": spark.range(parts).selectExpr("id AS p_partkey", "CASE id WHEN 0 THEN 'red widget' WHEN 3 THEN 'blue ring' ELSE concat('name ', id) END AS p_name", "concat('Brand#', id % 2) AS p_brand"),
        "orders": spark.range(lines // 4).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey"),
        "customer": spark.range(40).selectExpr("id AS c_custkey", "concat('Customer#', lpad(id, 9, '0')) AS c_name"),
        "documents": spark.range(20).selectExpr("id AS doc_id", "concat('the text ', id) AS text", "CASE id % 2 WHEN 0 THEN 'en' ELSE 'de' END AS lang", "concat('src', id) AS source"),
        "conversations": spark.range(20).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "concat('said ', id) AS text"),
        "embeddings": spark.range(40).selectExpr("id AS vec_id", "array(cast(id AS float), cast(1 AS float)) AS embedding", "cast(id % 5 AS int) AS label"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    stored = lambda: sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*"))
    before = stored()
    hits = load()[0]["answer_batch_ranked"](spark, str(tmp_path))
    got = {}
    for r in hits.collect():
        got.setdefault(r["route"], []).append((r["rank"], r["comment_text"], r["total"]))
    assert stored() - before < 20_000
    red = [i // 4 for i in range(0, lines, parts)]
    assert sorted(got["song"]) == [(n, f"[Setlist] red widget performed at gd{o}", len(red)) for n, o in enumerate(red[:20], 1)]
    assert sorted(got["guest"]) == [(n + 1, f"[Guest] Customer#{o % 40:09d} performed with Grateful Dead", 190) for n, o in enumerate([o for o in range(750) if 10 <= o % 40 <= 19][:10])]
    assert sorted(got["transition"]) == [(n, "[Transition] blue ring -> Brand#1", 100) for n in range(1, 11)]
    assert sorted(got["deadcast"]) == [(n + 1, f"[Deadcast] src{2 * n} (chunk 0)", 10) for n in range(10)]
    longest = [i for i in range(lines) if i % 2 == 0 and i % 50 == 48][:20]
    named = lambda p: {0: "red widget", 3: "blue ring"}.get(p, f"name {p}")
    assert sorted(got["ep"]) == [(n, f"[EP Duration] {named(i % parts)}: 49:00 (2940.0s) at gd{i // 4}", None) for n, i in enumerate(longest, 1)]
    mean = sum(range(3, 40, 5)) / 8
    near = sorted(range(40), key=lambda v: ((v - mean) ** 2, f"v{v}"))[:20]
    assert sorted(got["vector"]) == [(n, f"vector {v}", None) for n, v in enumerate(near, 1)]


def by_hand(text, titles):
    """Longest titles first, one pattern after the other, cut titles turned into marks."""
    ranked = sorted(dict.fromkeys(titles), key=len, reverse=True)
    text = text.strip()
    for n, title in enumerate(ranked):
        text = re.sub(rf"(?i)(?<![^ \x02]){re.escape(title)}(?=[ >&\x01]|$)", f"\x01{n}\x02", text)
    parts = re.split("[\x01\x02]", text)
    return [p for p in (ranked[int(p)].title() if i % 2 else p.strip() for i, p in enumerate(parts)) if p]


def test_titles_equal_one_pattern_a_title(spark):
    rng = random.Random(9)
    words = ["eyes", "dark", "star", "in", "st", "a&b"]
    for trial in range(4):
        titles = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(8)})
        texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ">", "&", ""]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = [r[0] for r in df.orderBy("i").select(S.segment_titles(F.col("t"), titles)).collect()]
        assert got == [by_hand(t, titles) for t in texts]


def test_many_titles_make_no_larger_plan(spark):
    titles = spark.range(5000).select(F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"))
    lists = spark.createDataFrame([("s", ["Title 17 title 4999 jam > title 1", None, ""])], "show_identifier string, entries array<string>")
    songs = S.normalize_legacy(lists, titles=titles)["songs"]
    assert [r["song_name"] for r in songs.orderBy(*S.POSITION).collect()] == ["Title 17", "Title 4999", "jam", "Title 1"]
    few = S.normalize_legacy(lists, titles=["title 1"])["songs"]
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(songs) - size(few)) < 200
    with pytest.raises(ValueError):
        S.known_titles(titles, most=10)


def test_routes_share_a_scan_and_count_all(spark):
    corpus = spark.createDataFrame(
        [(f"r{i}", "setlist_song", "Dark Star" if i % 3 else "Eyes", None, None, None, 0, 100 - i) for i in range(50)]
        + [("g", "guest_artist", None, "Dark Horse", None, None, 1, 1), ("t", "transition", None, None, "Dark Star", "Jam", 2, 1),
           ("u", "transition", None, None, "Dark Star", None, 2, 2)],
        "row_id string, type string, song_name string, guest_artist string, transition_from string, transition_to string, section int, position int"
    ).withColumn("text", F.lit(None).cast("string")).withColumn("duration_seconds", F.lit(None).cast("double"))
    asked = spark.createDataFrame([(1, 'song:"dark"'), (2, "guest:dark"), (3, "transition:dark -> JAM"), (4, "transition:dark"), (5, "song:none")],
                                  "question_id int, question string")
    got = {}
    for r in answer_batch(corpus, asked, limits={"song": 3}).collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["row_id"], r["total"], r["route"]))
    assert sorted(got[1]) == [(1, "r49", 33, "song"), (2, "r47", 33, "song"), (3, "r46", 33, "song")]
    assert got[2] == [(1, "g", 1, "guest")] and got[3] == [(1, "t", 1, "transition")]
    assert [x[1] for x in sorted(got[4])] == ["t", "u"] and 5 not in got


def test_joined_titles_equal_the_automaton(spark):
    rng = random.Random(21)
    words = ["eyes", "Dark", "star", "in", "st", "a&b", " star", "star ", "& co", "ñu"]
    for trial in range(3):
        titles = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(14)} | {"dark", "DARK", " eyes", "in "})
        texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ">", "&", ""]) for _ in range(rng.randint(0, 8))) for _ in range(120)]
        lists = [(i, [texts[i], None, texts[i - 1].swapcase()]) for i in range(len(texts))] + [(0, [texts[0]]), (None, [texts[1]]), (0, []), (1, None)]
        df = spark.createDataFrame(lists, "i int, x array<string>").repartition(5)
        known = spark.createDataFrame([(t,) for t in [*titles, titles[0], "", None]], "title string")
        want = df.select("i", S.segment_each(F.col("x"), titles).alias("s"))
        rows = lambda d: sorted(((r["i"], r["s"]) for r in d.collect()), key=str)
        for hot in (3, 10**6):
            assert rows(S.segment_joined(df, "x", known, "s", hot_rows=hot).select("i", "s")) == rows(want)


def test_titles_beyond_those_sent_to_tasks(spark):
    titles = spark.range(S.MOST_TITLES + 100).select(F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"))
    lists = spark.createDataFrame([("s", ["Title 17 title 200099 jam > title 1", None, ""]), ("s", ["title 5x TITLE 5"]), (None, ["Title 3"])],
                                  "show_identifier string, entries array<string>")
    songs = [(r["show_identifier"], r["item_no"], r["song_name"], r["transition"]) for r in S.normalize_legacy(lists, titles=titles)["songs"].collect()]
    assert sorted(songs, key=str) == sorted([
        ("s", 0, "Title 17", False), ("s", 1, "Title 200099", False), ("s", 2, "jam", False), ("s", 3, "Title 1", True),
        ("s", 0, "title 5x", False), ("s", 1, "Title 5", False), (None, 0, "Title 3", False)], key=str)
