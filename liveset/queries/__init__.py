"""Registered queries: every operator over whole tables, most with an equivalent in SQL.

``orders`` stand in for shows, ``lineitem`` for the songs of their sets, ``part`` for the
song catalogue; texts, pages, messages and vectors come from the tables of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a table reader, with its SQL equivalent where there is one."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


class Tables:
    """Tables of a data folder by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def __getattr__(self, table: str) -> DataFrame:
        return self.raw(table)


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from liveset.queries import archive, catalog, landed, search, texts  # noqa: F401

    return QUERIES, ORACLE
