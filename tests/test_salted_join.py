"""Joins on few heavy keys: the same rows as a plain join, and no task with much of them."""

from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from liveset.operators import search as Q
from liveset.scale import salted, salted_join


def frames(spark):
    many = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 300).cast("int")).alias("k"), F.col("id").alias("row"))
    few = spark.createDataFrame([(i, f"v{i}") for i in range(0, 310, 2)] + [(7, "w"), (7, "x"), (None, "y")], "k int, v string")
    return many.union(spark.createDataFrame([(None, -1)], "k int, row long")), few


def test_salted_join_equals_a_plain_one(spark):
    many, few = frames(spark)
    want = Counter(map(tuple, many.join(few, "k").select("k", "row", "v").collect()))
    for hot in (10, 100, 10**9):
        assert Counter(map(tuple, salted_join(many, few, ["k"], hot).select("k", "row", "v").collect())) == want
    assert salted_join(many.limit(0), few, ["k"], 10).count() == 0


def test_no_task_holds_much_of_a_heavy_key(spark):
    many, few = frames(spark)
    dealt, copied = salted(many, few, ["k"], 100)
    groups = [r["count"] for r in dealt.groupBy("k", "_salt").count().collect()]
    assert max(groups) < 200 and sum(groups) == 9001  # a third of all rows had one key
    # Only the heavy key's partners are copied.
    assert {r["k"] for r in copied.groupBy("k", "v").count().filter("count > 1").collect()} == {7}
    tasks = dealt.repartition(8, "k", "_salt").groupBy(F.spark_partition_id()).count().collect()
    sizes = [r["count"] for r in tasks]
    assert max(sizes) < 2 * median(sizes)


def test_one_date_on_a_third_of_the_rows(spark):
    corpus = spark.range(300).select(
        F.col("id").cast("string").alias("row_id"), F.lit("comment").alias("type"), F.lit("").alias("created"),
        F.when(F.col("id") % 3 == 0, "gd1977-05-08").otherwise(F.concat(F.lit("gd1978-06-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).alias("show_identifier"))
    asked = spark.createDataFrame([(1, "5/8"), (2, "1978-06-03"), (3, "nothing")], "question_id int, question string")
    today = F.to_date(F.lit("2024-01-01"))
    plain = sorted(map(tuple, Q.search_by_date(corpus, asked, today).collect()))
    assert plain == sorted(map(tuple, Q.search_by_date(corpus, asked, today, hot_rows=5).collect()))
    assert sum(r[0] == 1 for r in plain) == 100 and any(r[0] == 2 for r in plain)
