"""Sinks: corpus tables, vectors, graph files, reports and versioned publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liveset.scale import first_row_per_key


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", append: bool = False) -> None:
    df.write.format(fmt).mode("append" if append else "overwrite").save(path)


def append_transcripts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Concatenation that a repeated run does not double: the first row per URL stays."""
    stacked = existing.withColumn("_run", F.lit(0)).unionByName(incoming.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    numbered = stacked.withColumn("_digest", F.sha2(F.to_json(F.struct(*[c for c in stacked.columns if c != "_run"])), 256))
    return first_row_per_key(numbered, ["url"], ["_run", "_digest"]).drop("_run", "_digest")


def write_vectors(df: DataFrame, path: str) -> None:
    """Vector rows in folders by type, so that a typed search reads its own files only."""
    df.write.mode("overwrite").partitionBy("type").parquet(path)


def write_graph_csv(nodes: DataFrame, edges: DataFrame, nodes_path: str, edges_path: str) -> None:
    nodes.select("url", "depth", "in_degree", "out_degree").write.mode("overwrite").option("header", True).csv(nodes_path)
    edges.select("source", "target", "source_depth", "target_depth").write.mode("overwrite").option("header", True).csv(edges_path)


def write_graph_dot(lines: DataFrame, path: str) -> None:
    """Description lines sorted over the whole graph; parts read in file order."""
    lines.orderBy("section", "key").select("value").write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str, order: str = "rank") -> None:
    """Lines of a bounded report (a top-k ranking, a run summary)."""
    lines.orderBy(order).select("value").write.mode("overwrite").text(path)


# -- versioned publishing -----------------------------------------------------
def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers N of the committed folders ``name=N`` under ``path``, ascending."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        folder = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if folder.startswith(f"{name}=") and fs.exists(done):
            found.append(int(folder.split("=", 1)[1]))
    return sorted(found)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under ``path``: those whose write was committed."""
    return numbered_folders(spark, path, "version")


def publish(df: DataFrame, path: str, version: int) -> str:
    """Write a new version beside the old ones. It becomes current when Spark commits it,
    so a write that dies halfway changes nothing for readers; repeating it is safe."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    found = versions(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/version={found[-1]}") if found else None
