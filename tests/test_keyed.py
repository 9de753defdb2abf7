"""Tables kept by key: touched buckets only, replays, null keys, filters that spare reading."""

import os

import pytest
from pyspark.sql import functions as F

from liveset.streaming import ingest as I
from liveset.streaming import keyed as K

SCHEMA = "k string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def got(df):
    return sorted(map(tuple, df.select("k", "n").collect()), key=repr)


def files(folder):
    return {(os.path.relpath(os.path.join(d, f), folder), os.stat(os.path.join(d, f)).st_mtime_ns)
            for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_fold_replaces_keys_and_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    assert K.read_keyed(spark, path) is None and not K.fold(rows(spark), path, ["k"])
    first = [(f"k{i}", i) for i in range(200)] + [("k3", 1000), (None, 7), ("", 8)]
    assert K.fold(rows(spark, *first), path, ["k"], buckets=16, blocks=2)
    assert got(K.read_keyed(spark, path)) == sorted(first, key=repr)
    before, old = files(f"{path}/rows"), K.listing(spark, path)
    assert K.fold(rows(spark, ("k3", -1), (None, -2)), path, ["k"], buckets=99)
    state = K.listing(spark, path)
    assert state.buckets == 16 and len([f for f in state.folds.values() if f == 2]) <= 2
    assert before < files(f"{path}/rows")  # nothing rewritten, nothing gone
    assert {b: f for b, f in state.folds.items() if f == 1}.items() <= old.folds.items()
    want = [r for r in first if r[0] not in ("k3", None)] + [("k3", -1), (None, -2)]
    assert got(K.read_keyed(spark, path)) == sorted(want, key=repr)


def test_repeated_and_broken_folds(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    K.fold(rows(spark, ("a", 1), ("b", 2)), path, ["k"], 0, buckets=4, blocks=1)
    assert not K.fold(rows(spark, ("a", 9)), path, ["k"], 0)
    with monkeypatch.context() as m:  # dies after its rows are written, before the listing is
        m.setattr(K, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            K.fold(rows(spark, ("a", 5), ("c", 6)), path, ["k"], 1)
    assert got(K.read_keyed(spark, path)) == [("a", 1), ("b", 2)]
    assert K.fold(rows(spark, ("a", 5), ("c", 6)), path, ["k"], 1)
    assert got(K.read_keyed(spark, path)) == [("a", 5), ("b", 2), ("c", 6)]


def test_new_keys_read_no_stored_row(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert got(K.unseen(rows(spark, ("a", 1)), path, ["k"])) == [("a", 1)]
    K.fold(rows(spark, *[(f"k{i}", i) for i in range(300)], (None, 0)), path, ["k"], buckets=8, blocks=4)
    read, stored = [], K._stored
    monkeypatch.setattr(K, "_stored", lambda s, p, kind, *a: read.append((kind, *a[1:])) or stored(s, p, kind, *a))
    fresh = rows(spark, *[(f"new{i}", i) for i in range(300)])
    assert K.unseen(fresh, path, ["k"]).count() == 300
    assert [r[0] for r in read] == ["filters"]
    read.clear()
    mixed = fresh.unionByName(rows(spark, ("k5", 1), ("k5", 2), (None, 3)))
    assert got(K.unseen(mixed, path, ["k"])) == got(fresh)
    assert [r[0] for r in read] == ["filters", "rows"] and len(read[1][1]) <= 2  # the doubtful keys' buckets
    assert K.unseen(fresh.limit(0), path, ["k"]).count() == 0


def test_full_filters_change_no_result(spark, tmp_path):
    path = str(tmp_path / "t")
    K.fold(spark.range(0, 60000, 2).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("n")), path, ["k"], buckets=1, blocks=1)
    asked = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("n"))
    assert sorted(int(r.k) for r in K.unseen(asked, path, ["k"]).collect()) == list(range(1, 2000, 2))


def test_stream_of_new_keys(spark, tmp_path):
    src, path, ckpt = (str(tmp_path / n) for n in ("in", "t", "ckpt"))
    run = lambda: K.ingest_new(I.stream_parquet(spark, src, SCHEMA), path, ckpt, ["k"]).awaitTermination()
    rows(spark, ("a", 1), ("b", 2), ("b", 3)).write.parquet(src)
    run()
    rows(spark, ("b", 9), ("c", 4)).write.mode("append").parquet(src)
    run()
    run()
    assert got(K.read_keyed(spark, path)) == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]
    # A replay from a lost stream checkpoint finds every batch folded or every key known.
    K.ingest_new(I.stream_parquet(spark, src, SCHEMA), path, str(tmp_path / "again"), ["k"]).awaitTermination()
    assert got(K.read_keyed(spark, path)) == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]
