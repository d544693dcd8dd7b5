"""Graphs as edge tables: closures, paths, components.

Traversals are frontier loops. Each round is a join of the frontier with the
edges and an anti-join against what has been reached, materialised as a table
below the checkpoint folder so that plans stay short and a lost executor costs
one round. The number of rounds is bounded by the depth asked for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new place below the session's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tessella-graph-"))
        root = _LOCAL[0]
    return f"{root}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """The rows written below the session's checkpoint folder and read back."""
    path = folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, a: str, b: str, seeds: DataFrame, depth: int, seed: str = "seed") -> DataFrame:
    """(seed, node, depth): nodes reachable from each seed in at most ``depth``
    steps, at their least depth. A seed on a cycle is reached again."""
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    frontier = seeds.select(F.col(seed).alias("seed"), F.col(seed).alias("node")).distinct()
    reached = None
    for d in range(1, depth + 1):
        step = frontier.join(e, "node").select("seed", F.col("next").alias("node")).distinct()
        if reached is not None:
            step = step.join(reached, ["seed", "node"], "left_anti")
        frontier = save(step)
        if frontier.isEmpty():
            break
        found = frontier.withColumn("depth", F.lit(d))
        reached = found if reached is None else reached.unionByName(found)
    return reached if reached is not None else frontier.withColumn("depth", F.lit(0))


def shortest_paths(edges: DataFrame, a: str, b: str, start: int, end: int, depth: int = 40) -> DataFrame:
    """The first of the shortest paths (least chain of ids) from start to end, joined by ``>``."""
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, [start])], "node long, chain array<long>")
    seen = frontier.select("node")
    for d in range(1, depth + 1):
        # one chain a node is enough for a shortest path: the least one
        step = frontier.join(e, "node").select(F.col("next").alias("node"), F.concat("chain", F.array("next")).alias("chain"))
        step = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("chain").alias("chain"))
        frontier = save(step)
        if frontier.isEmpty():
            break
        hit = frontier.where(F.col("node") == end)
        if not hit.isEmpty():
            return hit.select(F.lit(d).alias("depth"), F.array_join("chain", ">").alias("path"))
        seen = seen.unionByName(frontier.select("node"))
    return spark.createDataFrame([], "depth int, path string")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each undirected component, by
    repeated minima over neighbours with pointer jumping."""
    both = save(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct())
    label = save(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = save(label.join(near, "node").join(jump, "component").select("node", F.least("component", "near", "far").alias("component")))
        if new.join(label.withColumnRenamed("component", "before"), "node").where("component <> before").isEmpty():
            return new
        label = new


def induced(edges: DataFrame, a: str, b: str, seeds: DataFrame, depth: int, seed: str = "seed") -> DataFrame:
    """All edges among the nodes reachable from the seeds, either way, and the seeds."""
    s = seeds.select(F.col(seed).alias("node"))
    down = closure(edges, a, b, seeds, depth, seed).select("node")
    up = closure(edges, b, a, seeds, depth, seed).select("node")
    nodes = save(s.union(down).union(up).distinct())
    inside = edges.join(nodes.withColumnRenamed("node", a), a, "left_semi")
    return inside.join(nodes.withColumnRenamed("node", b), b, "left_semi")
