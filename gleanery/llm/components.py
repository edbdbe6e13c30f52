"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


#: A node with more than 1 of so many link ends (and more than LEAST_HOT) is hot; so at most twice as many are.
HOT_NODES, LEAST_HOT = 4096, 256


def _with_least(pairs: DataFrame, most: int) -> DataFrame:
    """Each pair with the least of u and all its neighbours v. Hot nodes' leasts are broadcast, so no node's pairs gather in one task."""
    told = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("least"), F.count("*").alias("c"))
    hot = F.broadcast(told.where(F.col("c") > most).select("u", "least"))
    cold = told.where(F.col("c") <= most).select("u", "least")
    return pairs.join(hot, "u").unionByName(pairs.join(hot.select("u"), "u", "left_anti").join(cold, "u"))


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame, most: int) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    return _with_least(_both(links), most).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them; after a large star few nodes have several."""
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    moved = pairs.join(least, "u").where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component), written: each linked node and the least node of its component. links: columns u and v, no nulls.

    Each round is written to the shared folder, so a lost executor costs one round at most. Rounds end when the links
    are stars already, after O(log n) of them in practice.
    """
    now = materialize(links.where("u <> v").select("u", "v").distinct())
    seen = None
    most = max(LEAST_HOT, 2 * now.count() // HOT_NODES)
    while True:
        after = materialize(_small_star(_large_star(now, most)))
        # The table of links is the same as before if its size and an order-free digest of its rows are.
        told = tuple(after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        forget(now)
        now = after
        if told == seen or told[0] == 0:
            break
        seen = told
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = materialize(nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    forget(now)
    return found
