"""Link graphs: breadth-first levels, degrees, histograms, description text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveset import fixed
from liveset.scale import HOT_ROWS, checkpoint, copy_over, deal, salt_marks, side_by_side


PULL_GAIN = 2.0


class _Links:
    """Edges laid out by one of their ends, a hub's edges dealt over salts."""

    def __init__(self, edges: DataFrame, end: str, ends: DataFrame, hot_rows: int):
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        degree = "out_degree" if end == "source" else "in_degree"
        self.end, self.marks = end, salt_marks(ends, ["node"], hot_rows, degree)
        self.edges = checkpoint(deal(edges, self.marks, [end], ["target", "source"]).repartition(parts, end, "_salt"))

    def of(self, nodes: DataFrame) -> DataFrame:
        """Edges of ``nodes`` at this end. Only the nodes move, a hub once a salt."""
        return self.edges.join(copy_over(nodes.select(F.col("node").alias(self.end)), self.marks, [self.end]), [self.end, "_salt"]).drop("_salt")


def bfs(edges: DataFrame, seed: DataFrame, max_depth: int = 10, hot_rows: int = HOT_ROWS, pull_gain: float = PULL_GAIN) -> DataFrame:
    """``node, depth, parent`` of every node within ``max_depth`` of the seeds.

    ``edges``: source, target; ``seed``: node. A null is not a node. A node keeps the
    smallest discovering parent. A level either pushes (the edges out of its nodes, combined
    by target) or pulls (the edges into nodes not reached yet, matched with the level),
    whichever has fewer edges: it pulls where pushing would take ``pull_gain`` times as many.
    Both give the same rows. Edges are laid out once for each direction used, and a hub with
    more than ``hot_rows`` of them is shared by several tasks. Levels are checkpointed on the
    shared folder, so the plan stays flat and a lost executor repeats one level at most.
    """
    edges = checkpoint(edges.select("source", "target").filter("source is not null and target is not null").distinct())
    node_type = edges.schema["source"].dataType
    # Edges out of and into every node: hubs, and what a push or a pull would take.
    ends = checkpoint(degrees(edges, node="node"))
    forward, backward = _Links(edges, "source", ends, hot_rows), None
    level = checkpoint(seed.select(F.col("node").cast(node_type)).filter("node is not null").distinct()
                       .withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast(node_type)))
    visited, into_rest = level, edges.count()
    for depth in range(1, max_depth + 1):
        found = level.join(ends, "node", "left").agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("out"),
            F.coalesce(F.sum("in_degree"), F.lit(0)).alias("into")).first()
        into_rest -= found["into"]
        if not found["n"] or not found["out"] or not into_rest:
            break
        if found["out"] > pull_gain * into_rest:
            backward = backward or _Links(edges, "target", ends, hot_rows)
            rest = ends.filter("in_degree > 0").join(visited.select("node"), "node", "left_anti")
            met = copy_over(level.select(F.col("node").alias("source")), forward.marks, ["source"])
            reached = deal(backward.of(rest), forward.marks, ["source"], ["target", "source"]).join(met, ["source", "_salt"], "left_semi")
        else:
            reached = forward.of(level)
        reached = reached.groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent"))
        level = checkpoint(
            reached.join(visited.select("node"), "node", "left_anti")
            .select("node", F.lit(depth).alias("depth"), "parent"))
        visited = visited.unionByName(level)
    return visited


def tree_edges(levels: DataFrame) -> DataFrame:
    """Discovery tree of a search: one edge per node but the seeds."""
    return levels.filter("parent is not null").select(
        F.col("parent").alias("source"), F.col("node").alias("target"),
        (F.col("depth") - 1).alias("source_depth"), F.col("depth").alias("target_depth"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None, node: str = "url") -> DataFrame:
    """In- and out-degree per node, nodes without edges included when given.

    One pass: each edge adds to both ends, combined before the shuffle.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias(node), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias(node), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    if nodes is not None:
        ends = ends.unionByName(nodes.select(node).withColumn("i", F.lit(0)).withColumn("o", F.lit(0)))
    return ends.groupBy(node).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def node_table(levels: DataFrame, edges: DataFrame) -> DataFrame:
    named = levels.select(F.col("node").alias("url"), "depth")
    counts = degrees(edges)
    return named.join(counts, "url", "left").select(
        "url", "depth", F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
        F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def depth_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def graph_totals(levels: DataFrame, edges: DataFrame) -> DataFrame:
    return side_by_side(
        levels.agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth")),
        edges.agg(F.count(F.lit(1)).alias("edges")),
    )


def most_linked(node_degrees: DataFrame, k: int = 5, node: str = "url") -> DataFrame:
    return node_degrees.orderBy(F.desc("in_degree"), node).limit(k)


def graph_dot_lines(nodes: DataFrame, edges: DataFrame, name: str = "site", host: str = "") -> DataFrame:
    """Lines of a graph description: header, coloured nodes, edges, closing brace.

    ``section`` and ``key`` give the order of the lines.
    """
    spark = nodes.sparkSession
    colours = F.array(*[F.lit(c) for c in fixed.DEPTH_COLOURS])
    colour = F.get(colours, F.least(F.col("depth"), F.lit(len(fixed.DEPTH_COLOURS) - 1)))
    short = F.replace(F.replace("url", F.lit(host), F.lit("")) if host else F.col("url"), F.lit("/"), F.lit("/\\n"))
    label = F.when(short == "", "/").otherwise(short)
    frame = [(0, "0", f"digraph {name} {{"), (0, "1", "  rankdir=TB;"),
             (0, "2", "  node [shape=box, style=filled];"), (3, "", "}")]
    fixed_lines = spark.createDataFrame(frame, "section int, key string, value string")
    node_lines = nodes.select(F.lit(1).alias("section"), F.col("url").alias("key"), F.format_string(
        '  "%s" [label="%s", fillcolor="%s"];', "url", label, colour).alias("value"))
    edge_lines = edges.select(F.lit(2).alias("section"), F.concat_ws("\t", "source", "target").alias("key"),
                              F.format_string('  "%s" -> "%s";', "source", "target").alias("value"))
    return fixed_lines.unionByName(node_lines).unionByName(edge_lines)
