"""Best names by prefix-filtered joins, song texts and lists of three kinds, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from liveset.operators import format as R
from liveset.operators import search as Q


def score(question, name):
    q, n = question.split(), name.split()
    if question == name:
        return 1.0
    if question in name or name in question:
        return 0.8
    return 0.5 * len(set(q) & set(n)) / max(len(set(q)), len(n), 1)


@pytest.mark.parametrize("levels", [(0.0,), (0.25, 0.0), (0.5, 0.3, 0.1, 0.0)])
def test_best_names_hold_all_that_can_be_first(spark, monkeypatch, levels):
    monkeypatch.setattr(Q, "HEAVY_WORDS", 3)
    rng = random.Random(len(levels))
    words = ["the", "the", "of", "dark", "star", "eyes", "jam", "blue", "sky", "rain"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(120)})
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(25)] + ["nothing here", "", None]
    n = spark.createDataFrame([(x,) for x in names], "song_name string")
    q = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    for k in (1, 4, 500):
        got = {}
        for r in Q.best_names(n, q, k, levels=levels).collect():
            got.setdefault(r["question_id"], {})[r["song_name"]] = r["score"]
        for i, x in enumerate(asked):
            want = {name: score(x, name) for name in names if x and score(x, name) > 0}
            mine = got.get(i, {})
            assert all(abs(want[name] - s) < 1e-9 for name, s in mine.items())
            floor = sorted(want.values(), reverse=True)[:k][-1:] or [2]
            assert {name for name, s in want.items() if s >= floor[0]} <= set(mine)


def test_a_word_of_all_names_is_not_joined_on(spark, monkeypatch):
    names = spark.range(400).select(F.concat(F.lit("the song of "), F.lit("x"), F.col("id").cast("string"), F.lit(" "), F.lit("y"), (F.col("id") % 40).cast("string")).alias("song_name"))
    asked = spark.createDataFrame([(1, "the tale of y7 x7"), (2, "x49 of z the y9")], "question_id int, question string")
    filed, joined = Q.filed_words, []

    def seen(df, text, level):
        out = filed(df, text, level)
        joined.append((text, level, {r["w"] for r in out.collect()}))
        return out

    monkeypatch.setattr(Q, "filed_words", seen)
    best = Q.best_names(names, asked, 1).collect()
    assert {(r["question_id"], r["song_name"]) for r in best if r["score"] > 0.35} == {(1, "the song of x7 y7"), (2, "the song of x49 y9")}
    assert joined and {level for _, level, _ in joined} == {0.25}  # both were safe, no later level was asked
    asked_words = set().union(*(w for text, _, w in joined if text == "q"))
    assert "the" not in asked_words and "of" not in asked_words


def test_song_texts(spark):
    hits = spark.createDataFrame(
        [(1, 2, "lyric", "Song", None, ["u", "v"], ["A", "B"], [], "la la", None, None), (1, 3, "lyric", "Later", None, [], [], [], "no", None, None),
         (1, 1, "interpretation", "Song", None, [], [], [], "x" * 900, "notes", "link"), (1, 4, "interpretation", "Song", None, [], [], [], "two", "forum", ""),
         (1, 9, "interpretation", "Song", None, [], [], [], "beyond k", "forum", ""), (2, 1, "interpretation", "Other", None, [], [], [], "only", "notes", "")],
        "question_id int, rank int, type string, song_name string, title string, source_urls array<string>, lyricists array<string>, "
        "music_by array<string>, comment_text string, interpretation_source string, interpretation_url string")
    asked = spark.createDataFrame([(1, "song"), (2, "other"), (3, "none")], "question_id int, question string")
    got = {r["question_id"]: r for r in R.song_texts(asked, hits, 5).collect()}
    assert got[1]["lyrics"] == ("LYRICS — song\n\nSong: Song\nLyricists: A, B | Music: n/a\nSources:\n  • u\n  • v\n\nla la\n\n\n"
                                'Tip: use meaning "song name" for lyrics + interpretations.')
    assert got[1]["meaning"] == ("MEANING — song\n\nSong: Song\nSources:\n  • u\n  • v\n\nla la\n\n\nINTERPRETATIONS\n\n1. notes — link\n" + "x" * 800
                                 + "\n\n2. forum\ntwo")
    assert got[2]["lyrics"] == 'No lyrics found matching "other". Try meaning "song name".'
    assert got[2]["meaning"] == "MEANING — other\n\n\n\nINTERPRETATIONS\n\n1. notes\nonly"
    assert got[3]["meaning"] == 'No lyrics or interpretations found matching "none".'


def test_combined_search_keeps_the_order_of_its_lists(spark):
    corpus = spark.createDataFrame(
        [("a", "lyric", "dark star", "gd1977-05-08", "", [0.0]), ("b", "lyric", "dark star", "gd1978-05-08", "", [9.0]), ("c", "comment", "", "gd1977-05-08", "", [8.0])],
        "row_id string, type string, song_name string, show_identifier string, created string, embedding array<double>")
    asked = spark.createDataFrame([(1, "dark star", [0.0]), (2, "1977-05-08", [0.0])], "question_id int, question string, embedding array<double>")
    got = [tuple(r) for r in Q.combined_search(corpus, asked, 1, F.to_date(F.lit("2024-01-01"))).orderBy("question_id", "rank").select(
        "question_id", "row_id", "score_kind", "rank").collect()]
    assert got == [(1, "a", "distance", 1), (1, "b", "lexical", 2), (2, "a", "distance", 1), (2, "c", "date", 2)]
