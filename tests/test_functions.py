import datetime
import html
import random

import pytest
from pyspark.sql import functions as F

from liveset.functions import dates, text, urls
from liveset.functions.similarity import matching_ratio


@pytest.fixture()
def value(spark):
    """Evaluate a column over given strings."""

    def run(column, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        return [r[1] for r in df.select("i", column(F.col("c")).alias("x")).orderBy("i").collect()]

    return run


def test_whitespace(value):
    odd = "  a b \t\n c　"
    assert value(text.strip, odd, " x ", "") == ["a b \t\n c", "x", ""]
    assert value(text.collapse, odd, "a  b", "  ") == [" ".join(odd.split()), "a b", ""]
    assert value(text.words, odd, "", "one") == [odd.split(), [], ["one"]]


def test_durations(value):
    assert value(text.duration_seconds, "7:36", "456.5", "1:02:03", "", "abc", None) == [456, 456.5, 62, None, None, None]
    assert value(lambda c: text.duration_seconds(c, strict=True), "1:02:03", "7:36") == [None, 456]
    assert value(lambda c: text.duration_display(c.cast("double")), "456.7", "59.9", "3600") == ["7:36", "0:59", "60:00"]


def test_html(value):
    page = "A<br/>B <b>bold</b>\n\n  \nC\t D"
    assert value(text.clean_html, page, None) == ["A\nB bold\nC D", ""]
    assert value(text.clean_html_line, "<p>x &amp; y</p><script>no</script>&eacute;<!-- c -->z") == ["x & y é z"]
    assert value(text.strip_tags, "a<BR>b</p> <p class='k'>c &lt;i&gt;") == ["a\nb\n\nc <i>"]
    texts = ["&amp;lt;", "&nbsp;x", "plain", "&notit; &copy 1"]
    assert value(text.unescape, *texts, None) == [html.unescape(t) for t in texts] + [None]
    assert value(text.unescape_common, "&amp;lt; &quot;q&quot;") == ['&lt; "q"']


def test_song_names(value):
    raw = ["E: U.S. Blues", "Me & My Uncle", "Playin' In The Band", "Touch of Grey", "(Baby) Song One", "Set II - NFA", "12. WRS &amp; more"]
    assert value(text.song_key, *raw) == ["u s blues", "me and my uncle", "playing in band", "touch of gray", "song one",
                                          "not fade away", "weather report suite and more"]
    raw = ["1. Ripple [7:52]", "d2t01 - Space", "08 Dark Star (reprise)", "* (12) 7: Eyes (note 2)", "Bertha ->&gt;,"]
    assert value(text.clean_song_title, *raw) == ["Ripple", "Space", "Dark Star (reprise)", "Eyes", "Bertha"]
    noise = ["Jerry Garcia - Guitar", "tuning", "x" * 61, "encore", "Dark Star", "Drums", "d1t02", "http://x", "Jam session"]
    assert value(text.is_song_noise, *noise) == [True, True, True, True, False, True, True, True, True]
    assert value(text.loose_key, "St. Stephen!") == ["st stephen"]


def test_tracks_and_links(value):
    got = value(text.disc_track, "gd77d2t03.mp3", "gd77s1t01.mp3", "track.mp3", "x-t07.flac")
    assert [tuple(g) for g in got] == [(2, 3), (1, 1), (1, 9999), (1, 7)]
    assert value(text.track_number, "gd77-05-07d1t02", "03 song", "none") == [2, 3, 9999]
    assert value(text.show_url, "gd1", "", None) == ["https://archive.org/details/gd1", "", ""]
    assert value(text.clean_track_title, "Drums -> Space >") == ["drums  space"]


def test_relevance(value):
    assert value(text.is_relevant, "what a GREAT Show it was", "show", "nothing here at all", None) == [True, False, False, False]


def test_match_context(spark):
    body = "a" * 150 + "NEEDLE" + "b" * 400
    df = spark.createDataFrame([("t", body), ("the needle title", body), ("x", "none")], "t string, b string")
    got = [r[0] for r in df.select(text.match_context("t", "b", F.lit("needle"))).collect()]
    assert got == [body[50:450], "the needle title", ""]


def test_show_dates(value):
    got = value(dates.show_date, "gd72-11-14.sbd.x", "gd1977-05-08.x", "misc", "gd05-01-02")
    assert [g and tuple(g) for g in got] == [(1972, 11, 14), (1977, 5, 8), None, (2005, 1, 2)]
    got = value(lambda c: dates.show_date(F.lit("misc"), F.lit("setlist_song"), c), "1977-05-08 00:00:00", "bad")
    assert [g and tuple(g) for g in got] == [(1977, 5, 8), None]
    assert value(dates.long_date, "1977-05-08", "", "soon", None) == ["May 08, 1977", "unknown", "soon", "unknown"]


def test_date_phrases(value):
    today = F.to_date(F.lit("2024-09-25"))
    asked = {
        "shows on Sep 25": (None, 9, 25), "9/25": (None, 9, 25), "1974-09-25": (1974, 9, 25), "gd1974-09-25": (1974, 9, 25),
        "September twenty-fifth": (None, 9, 25), "Sep twenty five": (None, 9, 25), "today": (2024, 9, 25), "best jam": None,
        "9-25": (None, 9, 25), "13/40": None, "September 25th, 1974": (1974, 9, 25), "march first 1990": (1990, 3, 1),
        "played 9/25/1974": None, "may third": (None, 5, 3), "decide 5": (None, 12, 5), "june thirty-one": (None, 6, 31), "june thirty five": None,
    }
    got = value(lambda c: dates.parse_date_phrase(c, today), *asked)
    assert {q: g and tuple(g) for q, g in zip(asked, got)} == asked
    assert value(lambda c: dates.resolve_today(c, today), "What Today?", "todays") == ["What September 25, 2024?", "todays"]


def test_title_dates(value):
    assert value(dates.title_show_date, "on GD1977-05-08!", "the 1977-05-08 show", "5/8/1977", "none") == [
        "GD1977-05-08", "1977-05-08", "5/8/1977", None]


def test_urls(value):
    assert value(urls.canonical_url, "https://h/x?page=2&ref=y#z", "HTTP://h/a?b=1", "https://h") == ["https://h/x?page=2", "http://h/a", "https://h"]
    assert value(lambda c: urls.is_internal(c, "h"), "https://h/x", "mailto:a@h", "https://o/", "http://h") == [True, False, False, True]
    base = F.lit("https://h/a/b?q=1#f")
    assert value(lambda c: urls.resolve_url(base, c), "/x", "y", "../z?k", "//o/p", "?n", "#t", "http://u/", "./") == [
        "https://h/x", "https://h/a/y", "https://h/z?k", "https://o/p", "https://h/a/b?n", "https://h/a/b?q=1#t", "http://u/", "https://h/a/"]


def test_matching_ratio_bound_keeps_close_pairs(spark):
    from difflib import SequenceMatcher
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words[:20]]
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("r", matching_ratio("a", "b", 0.7)).collect()
    for a, b, r in got:
        exact = SequenceMatcher(None, a, b).ratio()
        assert r == pytest.approx(exact) if exact >= 0.7 else r <= exact


def test_number_words_cover_the_month(value):
    ones = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth"]
    assert value(dates.number_word, *[f"twenty-{o}" for o in ones]) == list(range(21, 30))
    assert value(dates.number_word, "ten five", "dog", "") == [None, None, None]
    assert datetime.date(2024, 9, 25).strftime("%B") == "September"
