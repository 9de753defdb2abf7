"""Cutting long texts into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.functions.text import words


def chunk_words(df: DataFrame, text: str, size: int = fixed.CHUNK_WORDS) -> DataFrame:
    """Consecutive chunks of ``size`` words: chunk_index, chunk, word_count."""
    parts = F.when(F.size("_w") > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / size).cast("int")),
        lambda i: F.slice("_w", i * size + 1, F.lit(size)),
    ))
    keep = [c for c in df.columns if c != text]
    return (
        df.withColumn("_w", words(text))
        .select(*keep, F.posexplode(parts).alias("chunk_index", "_c"))
        .select(*keep, "chunk_index", F.array_join("_c", " ").alias("chunk"), F.size("_c").alias("word_count"))
    )


def split_text(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Parts no longer than ``limit``, cut at the last newline of the window when that lies
    at or beyond its middle, else hard; leading newlines of the rest are dropped.

    Every cut takes at least half the window, which bounds the number of steps exactly.
    """
    least = max(1, limit // 2)
    steps = F.sequence(F.lit(1), F.floor(F.length("_t") / least).cast("int") + 1)

    def step(acc, _):
        rest = acc["rest"]
        window = F.substring(rest, 1, limit)
        newline = limit - F.instr(F.reverse(window), "\n")
        cut = F.when(F.contains(window, F.lit("\n")) & (newline >= limit // 2), newline).otherwise(limit)
        after = F.regexp_replace(F.substring(rest, cut + 1, F.length(rest)), "^\n+", "")
        return F.when(F.length(rest) > limit, F.struct(
            after.alias("rest"), F.concat(acc["parts"], F.array(F.substring(rest, F.lit(1), cut))).alias("parts"))
        ).otherwise(acc)

    start = F.struct(F.col("_t").alias("rest"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(steps, start, step, lambda acc: F.concat(acc["parts"], F.array(acc["rest"])))
    keep = [c for c in df.columns if c != text]
    last = F.size("_p") - 1
    return (
        df.withColumn("_t", F.col(text)).withColumn("_p", done)
        .select(*keep, F.posexplode("_p").alias("part_no", "part"), last.alias("_last"))
        .filter((F.col("part_no") < F.col("_last")) | (F.col("part") != ""))
        .drop("_last")
    )
