from pyspark.sql import functions as F

from liveset.operators import setlists as S


def items(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "show_identifier string, description string")


def rows(df, *cols, order=None):
    df = df.orderBy(*(order or S.POSITION))
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_extract_setlists_fixture(spark):
    t = S.extract_setlists(items(spark, "Intro line<br/>Set 1<br/>Song A, Song B -> Song C<br/>Encore<br/>Song D*"))
    assert rows(t["songs"], "set_name", "song_name", "notations") == [
        ("Set 1", "Song A", []), ("Set 1", "Song B", []), ("Encore", "Song D", ["*"])]
    assert rows(t["transitions"], "transition_from", "transition_to") == [("Song B", "Song C")]
    assert rows(t["sets"], "set_order", "set_name", order=["set_order"]) == [(0, "Set 1"), (1, "Encore")]


def test_markers_credits_chains_and_guests(spark):
    text = ("Disc 2 ignored text\nSource: SBD\nA > B > C,Set break, \nset one\nX\nEncore 2\n"
            "Notes: none\nZ ^ 12\nOther artist(s): Pat, , Lee\nmore")
    t = S.extract_setlists(items(spark, text))
    assert rows(t["sets"], "set_name", order=["set_order"]) == [("Set 2",), ("set one",), ("Encore",)]
    assert rows(t["songs"], "set_name", "song_name", "transition", "notations") == [
        ("Set 2", "A", True, []), ("set one", "X", False, []), ("Encore", "Z", False, ["^", "12"]),
        ("Encore", "more", False, [])]
    assert rows(t["transitions"], "transition_from", "transition_to") == [("A", "B")]
    assert rows(t["guests"], "guest_artist", order=["guest_no"]) == [("Pat",), ("Lee",)]


def test_normalize_legacy_fixture(spark):
    df = spark.createDataFrame([("s", ["Set I Dark Star > Morning Dew", "Encore", "Casey Jones"])],
                               "show_identifier string, entries array<string>")
    t = S.normalize_legacy(df)
    assert rows(t["songs"], "set_name", "song_name", "transition") == [
        ("Set I", "Dark Star", False), ("Set I", "Morning Dew", True), ("Encore", "Casey Jones", False)]
    assert rows(t["transitions"], "transition_from", "transition_to") == [("Dark Star", "Morning Dew")]


def test_normalize_legacy_lazy_set_and_players(spark):
    df = spark.createDataFrame(
        [("s", ["Bertha", "Jerry - Guitar", "sugar magnolia dark star > eyes", "Disc 2", "A &gt; B"])],
        "show_identifier string, entries array<string>")
    t = S.normalize_legacy(df)
    assert rows(t["songs"], "set_name", "song_name", "transition") == [
        ("Set I", "Bertha", False), ("Set I", "Sugar Magnolia", False), ("Set I", "Dark Star", False),
        ("Set I", "Eyes", True), ("Disc 2", "A", False), ("Disc 2", "B", True)]
    assert rows(t["transitions"], "transition_from", "transition_to") == [("Dark Star", "Eyes"), ("A", "B")]
    assert rows(t["sets"], "set_name", "musicians", order=["set_order"]) == [("Set I", "Jerry - Guitar"), ("Disc 2", None)]
    assert S.legacy_description(df).first()["raw_description"] == "Jerry - Guitar"


def test_segment_titles_longest_first(spark):
    df = spark.createDataFrame([("sugar magnolia sugar my tune",), ("spacey eyes",), ("one more saturday night",)], "t string")
    got = [r[0] for r in df.select(S.segment_titles(F.col("t"))).collect()]
    assert got == [["Sugar Magnolia", "Sugar", "my tune"], ["spacey", "Eyes"], ["One More Saturday Night"]]


def test_flat_and_ordered_songs(spark):
    flat = S.flat_songs(items(spark, "A, B->C,  ,D"))
    assert rows(flat, "song_name", order=["item_no", "part_no"]) == [("A",), ("B",), ("C",), ("D",)]
    got = S.ordered_songs(items(spark, "Set 1\nJerry Garcia on guitar\nBertha, Tune up, Dark Star -> Space\nEncore: x"))
    assert rows(got, "song_name", order=["line_no", "item_no"]) == []
    got = S.ordered_songs(items(spark, "Set 1\nBertha, Dark Star &gt; Space"))
    assert rows(got, "song_name", order=["line_no", "item_no"]) == [("Bertha",), ("Dark Star",)]


def test_set_numbers_and_transitions_same_with_hot_keys(spark):
    df = spark.range(0, 400).select(
        F.when(F.col("id") < 150, 1).otherwise(F.col("id") % 7 + 2).alias("k"), F.col("id").alias("pos"),
        (F.col("id") % 5 == 0).alias("mark"), F.concat(F.lit("s"), F.col("id")).alias("song"))
    plain = S.set_numbers(df, ["k"], ["pos"], F.col("mark"))
    split = S.set_numbers(df, ["k"], ["pos"], F.col("mark"), hot_rows=20)
    assert sorted(plain.collect()) == sorted(split.collect())
    plain = S.transitions_in_order(df, ["k"], ["pos"], "song")
    split = S.transitions_in_order(df, ["k"], ["pos"], "song", hot_rows=20)
    assert sorted(plain.collect()) == sorted(split.collect())
