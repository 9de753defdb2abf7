"""Documents to packed token sequences: ``STAGES`` of (name, function).

A function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them back for the next. All stages
but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liveset.llm import decontaminate, jaccard, langid, packing, substrings
from liveset.llm.common import bucket_of, written
from liveset.llm.queries import table, word_tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without a letter go. A null ``lang``
    takes the predicted one."""
    network = langid.train(docs.filter(bucket_of("doc_id", 4) != 2))
    known = langid.identify(docs, network).filter(F.col("lang_pred") != langid.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest ``doc_id``."""
    return jaccard.one_of_each(docs, threshold=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 35 words or more that repeat; ``n_chars`` follows. A document
    that loses all its words stays, with an empty text."""
    kept = substrings.remove_repeats(docs, window=35)
    kept = kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4,096 tokens."""
    return packing.pack(docs, word_tokenizer(), window=4096, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Trained networks and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
