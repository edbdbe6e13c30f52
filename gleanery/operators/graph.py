"""Operators over an edge table (source, target, relation, confidence): bounded traversals and quality."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends of all edges."""
    ends = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("node")
    no_source = edges.join(known.withColumnRenamed("node", "source"), "source", "left_anti").withColumn("side", F.lit("source"))
    no_target = edges.join(known.withColumnRenamed("node", "target"), "target", "left_anti").withColumn("side", F.lit("target"))
    return no_source.unionByName(no_target)


def callers(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): which nodes lead to a seed in at most `depth` steps, each with its least; seeds are left out."""
    step = edges.select("source", "target").distinct()
    reached, front = seeds.select("node", F.lit(0).alias("depth")), seeds.select("node")
    for d in range(1, depth + 1):
        found = step.join(front.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node")).distinct()
        front = written(found.join(reached.select("node"), "node", "left_anti"))
        reached = reached.union(front.withColumn("depth", F.lit(d)))
    return reached.where("depth > 0").select("node", F.col("depth").cast("long").alias("depth"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir; an own one only where all run on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='gleanery-')}")
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again: made once, whatever reads it, and kept if executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most: int = 1 << 16) -> DataFrame:
    """A written table for a join with a large one: it goes to all tasks if it has few rows, else neither side does.

    Spark takes the size of files for that of rows, which may be a hundred times as much once texts are unpacked and lists
    opened, and would send the large side through the driver.
    """
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): all that seeds lead to, in any number of steps; seeds are left out. Goes on until no new node appears."""
    step = edges.select("source", "target").distinct().persist()
    seeds = written(seeds.select("node").distinct())
    front = reached = seeds
    rounds = 0
    while not front.isEmpty():
        found = step.join(front.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node")).distinct()
        front = written(found.join(reached, "node", "left_anti"))
        reached = reached.union(front)
        rounds += 1
        if rounds % 16 == 0:  # plans stay short in deep graphs
            reached = written(reached)
    step.unpersist()
    return reached.join(seeds, "node", "left_anti")


def lineage(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, score): reverse lineage of seeds (node, score); each hop multiplies by .72 + .2 confidence; no node twice on a trail."""
    step = edges.groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    walk = seeds.select("node", F.col("score").cast("double").alias("score"), F.array("node").alias("trail"))
    found = []
    for _ in range(hops):
        walk = step.join(walk.withColumnRenamed("node", "target"), "target").where(~F.array_contains("trail", F.col("source")))
        walk = written(walk.select(F.col("source").alias("node"), (F.col("score") * (0.72 + 0.2 * F.col("confidence"))).alias("score"), F.concat("trail", F.array("source")).alias("trail")))
        found.append(walk.select("node", "score"))
    best = reduce(DataFrame.union, found).groupBy("node").agg(F.round(F.max("score"), 6).alias("score"))
    return best.join(seeds.select("node"), "node", "left_anti")


def several_owners(edges: DataFrame) -> DataFrame:
    """Targets with more than one distinct source."""
    return edges.groupBy("target").agg(F.countDistinct("source").alias("owners")).where("owners > 1")


def governance(edges: DataFrame) -> DataFrame:
    """One row a relation: edges, mean confidence, and how many have a confidence below one half."""
    return edges.groupBy("relation").agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") < 0.5).alias("low_confidence"))


def superseded(edges: DataFrame) -> DataFrame:
    """Active edges after supersession: of edges with one (source, relation, target) the strongest and latest stays open."""
    from .tables import top_per_group

    return top_per_group(edges, ["source", "relation", "target"], [F.desc("confidence"), F.desc("recorded"), F.col("edge_id")], 1)


def unordered(edges: DataFrame) -> DataFrame:
    """(node): steps that no order can place, as they lie on a cycle or behind one. Steps without an open step before them are
    peeled off layer by layer until none is left."""
    now = written(edges.where("source <> target").select("source", "target").distinct())
    left = now.count()
    while left:
        now = written(now.join(now.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target"))
        before, left = left, now.count()
        if left == before:
            break
    return now.select(F.col("source").alias("node")).union(now.select("target")).distinct()
