"""Relational operators: selections with fallback, tops, latest rows, snapshots, merges, percentiles, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark limits rows within tasks before it shuffles."""
    ranked = df.withColumn("__place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("__place") <= k).drop("__place")


def matching_or_all(df: DataFrame, match: Column, group: list[str]) -> DataFrame:
    """Rows that match; all rows of a group in which none does."""
    matched = df.where(match)
    without = df.join(matched.select(*group).distinct(), group, "left_anti")
    return matched.unionByName(without)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) between two snapshots: added, removed, changed or unchanged."""
    a = before.select(F.col(key), F.col(digest).alias("__old"), F.lit(True).alias("__in_old"))
    b = after.select(F.col(key), F.col(digest).alias("__new"), F.lit(True).alias("__in_new"))
    change = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A new snapshot: incoming rows replace those with their keys."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def insert_new(current: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """A new snapshot with incoming rows whose key is new; of several with one key the first. Null keys never collide."""
    keyed = top_per_group(incoming.where(F.col(key).isNotNull()), [key], order, 1)
    fresh = keyed.join(current.where(F.col(key).isNotNull()).select(key), key, "left_anti")
    return current.unionByName(fresh.select(*current.columns)).unionByName(incoming.where(F.col(key).isNull()).select(*current.columns))


def chain_breaks(df: DataFrame, group: str, sequence: str, digest: str, previous: str) -> DataFrame:
    """(group, entries, broken, gaps): entries whose stored previous digest is not that of the entry before (null at
    first), and entries whose number does not follow that of the entry before (1 at first)."""
    order = Window.partitionBy(group).orderBy(sequence)
    linked = df.withColumns({"__digest": F.lag(digest).over(order), "__sequence": F.lag(sequence).over(order)})
    follows = F.col(sequence).eqNullSafe(F.coalesce("__sequence", F.lit(0)) + 1)
    return linked.groupBy(group).agg(F.count("*").alias("entries"), F.count_if(~F.col(previous).eqNullSafe(F.col("__digest"))).alias("broken"), F.count_if(~follows).alias("gaps"))


def nearest_rank(df: DataFrame, group: list[str], value: str, percent: list[float]) -> DataFrame:
    """Percentiles at the place round((n - 1) * p), halves to even, of each group's ordered values.

    Values are dealt by ranges of group and value, so a large group is ordered by many tasks; the rows before each range
    come from counts, one row for each group and task.
    """
    from .graph import written

    known = df.where(F.col(value).isNotNull()).select(*group, value)
    dealt = written(known.repartitionByRange(*group, value).withColumn("__task", F.spark_partition_id()))
    counts = dealt.groupBy(*group, "__task").agg(F.count("*").alias("__c"), F.sum(value).alias("__s"))
    by = Window.partitionBy(*group)
    starts = counts.withColumns({"__before": F.sum("__c").over(by.orderBy("__task")) - F.col("__c"), "__n": F.sum("__c").over(by), "__mean": F.sum("__s").over(by) / F.sum("__c").over(by)})
    placed = dealt.withColumn("__i", F.row_number().over(Window.partitionBy(*group, "__task").orderBy(value)) - 1).join(starts, [*group, "__task"])
    wanted = [F.bround((F.col("__n") - 1) * p).cast("long") for p in percent]
    here = F.col("__before") + F.col("__i")
    picks = [F.max(F.when(here == w, F.col(value))).alias(f"p{round(100 * p)}") for w, p in zip(wanted, percent, strict=True)]
    return placed.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.max("__mean"), 6).alias("mean"), *picks)


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int, left_span: tuple[str, str] = ("a", "b"), right_span: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Rows of two tables with one key whose spans of whole numbers overlap.

    Spans are cut into buckets of a width and meet by key and bucket, in the bucket where the later of both begins; so
    pairs that lie far apart never meet, however many rows a key has.
    """
    buckets = lambda df, span: df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor(F.col(span[1]) / width))))
    met = buckets(left, left_span).join(buckets(right, right_span), [key, "__bucket"])
    (a, b), (x, y) = left_span, right_span
    first = F.floor(F.greatest(F.col(a), F.col(x)) / width) == F.col("__bucket")
    return met.where((F.col(a) <= F.col(y)) & (F.col(b) >= F.col(x)) & first).drop("__bucket")


def merged_intervals(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Intervals of each group, those that touch or overlap joined into one."""
    order = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    island = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*group, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def filled_forward(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Each null takes the last value before it."""
    seen = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(seen))


def page(df: DataFrame, group: str, order: list[Column], per_group: int, cursor: int, size: int) -> DataFrame:
    """One page of rows merged from groups: each group offers its first cursor + per_group rows."""
    offered = top_per_group(df, [group], order, cursor + per_group)
    return offered.orderBy(*order).offset(cursor).limit(size)
