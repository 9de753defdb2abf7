"""Extra columns with any name pass through unchanged, whatever an operator calls its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liveset.llm import decontaminate, jaccard, langid, quality, sharding, substrings

NAMES = ["_rid", "_key", "_later", "_letter", "_first", "_n", "_copied", "_root", "_least", "_others", "_item", "_Bin", "Places", "key", "KEYED",
         "Class_ID", "N_Copies", "n_links", "SLOT", "Shard", "Lang_Pred", "lang_score", "Kept_Text", "N_WORDS", "n_removed", "Stats", "Quality_Score",
         "a.b", "with space", "tick`ed", "best", "comp", "band", "at", "doc", "k", "s", "x"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    shared = prose(1, 60)
    texts = [prose(i, 80) for i in range(2, 8)] + [prose(2, 80), prose(9, 20) + " " + shared, prose(10, 20) + " " + shared, None, "", "one"]
    columns = ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES)
    rows = [(i, t, *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("names") / "docs")
    spark.createDataFrame(rows, f"doc_id long, text string, {columns}").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def check(out, docs, added=(), without=()):
    replaced = {c.lower() for c in added}
    kept = [c for c in docs.columns if c.lower() not in replaced and c not in without]
    assert out.columns == [*kept, *added]
    rows = out.collect()
    for r in rows:
        for n in kept:
            if n in NAMES:
                assert r[n] == f"{n}-{r['doc_id']}"
    return {r["doc_id"]: r for r in rows}


def test_near_duplicates(docs):
    got = check(jaccard.near_duplicates(docs), docs, jaccard.ADDED)
    assert len(got) == 12 and got[6]["class_id"] == 0 and got[6]["n_copies"] == 2
    assert sorted(check(jaccard.one_of_each(docs), docs)) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]


def test_repeats(docs):
    got = check(substrings.remove_repeats(docs), docs, substrings.ADDED)
    assert {i: r["n_removed"] for i, r in got.items()} == {0: 80, 6: 80, 7: 60, 8: 60, **{i: 0 for i in (1, 2, 3, 4, 5, 9, 10, 11)}}


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, prose(3, 80)), (2, prose(50, 30))], "item_id long, text string").withColumn("_Item", F.lit("y"))
    assert sorted(check(decontaminate.without_leaks(docs, items), docs)) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    leaks = decontaminate.leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in leaks] == [(1, 1)]


def test_language_quality_and_shards(docs):
    network = langid.Network(["xx"])
    network.look_ups()
    for chosen in (network, None):
        assert len(check(langid.identify(docs, chosen), docs, langid.ADDED)) == 12
    measures = quality.measured(docs)
    for model in (None, quality.fit(measures.withColumn("label", (F.col("doc_id") % 2).cast("int")).select("stats", "label"))):
        assert len(check(quality.scored(measures, model), docs, ("quality_score",), ("text", "Stats"))) == 12
    assert len(check(measures, docs, ("stats",), ("text",))) == 12
    assert len(check(sharding.place(docs, F.col("doc_id")), docs, sharding.ADDED)) == 12
