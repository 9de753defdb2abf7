"""The pipeline stage by stage against brute force, on a table with every awkward row."""

import os
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402

from liveset.llm import jaccard, substrings  # noqa: E402
from liveset.llm.common import written  # noqa: E402
from liveset.llm.tokens import Encoder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n)]


ITEM = " ".join(prose(900, 20))


def rows():
    a, b = prose(1, 120), prose(2, 60)
    texts = [
        " ".join(a), " ".join(a), " ".join(a[:60] + ["x"] + a[61:]), None, "", "123 !!", " ".join(prose(3, 30) + b + prose(4, 30)),
        "\n".join(prose(5, 10) + b + prose(6, 50)), " ".join(prose(7, 40)) + " " + ITEM, " ".join(prose(8, 5_000)), "short one", "short one",
    ]
    out = [(i, t, "en" if i % 2 else None, "s", len(t) if t else None) for i, t in enumerate(texts)]
    return [*out, out[6], (None, " ".join(prose(11, 50)), None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == columns and docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
        after = docs.collect()
        if name == "language_id":
            fine = [r for r in before if re.search(r"[^\W\d_]", r["text"] or "")]
            assert sorted(map(str, ((r["doc_id"], r["text"]) for r in after))) == sorted(map(str, ((r["doc_id"], r["text"]) for r in fine)))
            assert all(r["lang"] is not None for r in after)
        if name == "near_duplicates":
            before.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            keep = {root for root, _ in jaccard.brute_force([r["text"] for r in before])}
            assert sorted(str(r["doc_id"]) for r in after) == sorted(str(before[k]["doc_id"]) for k in keep)
        if name == "substring_dedup":
            want = {r["doc_id"]: (n - gone) for r, (n, gone, _) in zip(before, substrings.brute_force([r["text"] for r in before]))}
            assert {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in after} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after) and len(after) == len(before)
        if name == "benchmark_decontamination":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {8}
    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"), whole=True)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total"))
    assert {r["doc_id"]: (r["n"], r["total"]) for r in pieces.collect()} == {r["doc_id"]: (len(encode.encode(r["text"])) + 1,) * 2 for r in docs.collect()}


def test_whole_run_and_an_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
