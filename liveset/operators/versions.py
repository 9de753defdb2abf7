"""Versions of a table as multisets: numbered equal rows, what changed, and what follows from it.

Equal rows share an id; with the number of their occurrence they are told apart. Two versions
differ by the occurrences that one has more than the other, which needs one count an id and no
order. Counts that are kept follow the changes alone: neither version is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveset.operators.vectors import embed
from liveset.scale import row_ordinal

ADDED, REMOVED = "added", "removed"


def numbered(rows: DataFrame, order: Sequence[str], key: str = "row_id", **kw) -> DataFrame:
    """``rows`` with ``occurrence``, from 1 among those that share ``key``."""
    return row_ordinal(rows, [key], order, "occurrence", **kw)


def changes(old: DataFrame, new: DataFrame, key: str = "row_id") -> DataFrame:
    """``key``, ``occurrence``, ``change``: the rows that ``new`` has more (added) or fewer
    (removed) than ``old``, as a multiset difference. A null key is a key like any other."""
    # One count an id and mapper; both versions go through one shuffle.
    stacked = old.select(key, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionByName(new.select(key, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    counts = stacked.groupBy(key).agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n")).filter("_o <> _n")
    return counts.select(
        key, F.explode(F.sequence(F.least("_o", "_n") + 1, F.greatest("_o", "_n"))).alias("occurrence"),
        F.when(F.col("_n") > F.col("_o"), ADDED).otherwise(REMOVED).alias("change"))


def reference_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``n``, how many rows hold them."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def fold_changes(counts: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts after some changes: ``changed`` has ``keys`` and ``change``, one row an occurrence.
    A key that no row holds any more is gone, so distinct numbers follow as well."""
    signed = changed.select(*keys, F.when(F.col("change") == ADDED, 1).otherwise(-1).cast("long").alias("n"))
    return counts.select(*keys, F.col("n").cast("long").alias("n")).unionByName(signed).groupBy(*keys).agg(
        F.sum("n").alias("n")).filter("n > 0")


def totals(counts: DataFrame) -> DataFrame:
    """Rows and distinct keys of kept counts."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"))


def follow_vectors(vectors: DataFrame, counts: DataFrame, changed: DataFrame, new: DataFrame, encoder: Callable,
                   text: str = "text", key: str = "row_id") -> DataFrame:
    """``key`` and ``embedding`` for every id of the new version: vectors of ids that no row holds
    any more go, ids that came in are embedded, all others stay as they are. ``counts`` are
    those of the old version.

    Texts pass by a hashed set of the ids that came in and are embedded on the way: none is
    sorted or kept. Only vectors are gathered by id, as equal rows of an id have one each."""
    touched = changed.select(key).distinct()
    still = fold_changes(counts.join(touched, key, "left_semi"), changed, [key]).select(key)
    gone = touched.join(still, key, "left_anti")
    came = still.join(vectors.select(key), key, "left_anti")
    texts = new.select(key, text).join(came.hint("shuffle_hash"), key, "left_semi")
    return vectors.select(key, "embedding").join(gone, key, "left_anti").unionByName(one_vector(embed(texts, encoder, text), key))


def one_vector(embedded: DataFrame, key: str = "row_id") -> DataFrame:
    """``key`` and ``embedding`` of one row an id; what else the rows hold does not travel."""
    return embedded.select(key, "embedding").groupBy(key).agg(F.any_value("embedding").alias("embedding"))
