"""Aggregation of observation events: confirmation, outcomes, misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Independent tasks that confirm a signal.
CONFIRMED_BY = 2


def stable_signals(events: DataFrame) -> DataFrame:
    """(record_id, outcome, events, tasks, stable): stable if verified once or seen in two tasks; an event without task counts alone."""
    task = F.coalesce(F.col("task_id").cast("string"), F.concat(F.lit("legacy-event:"), F.col("event_id").cast("string")))
    found = events.groupBy("record_id", "outcome").agg(F.count("*").alias("events"), F.countDistinct(task).alias("tasks"), F.coalesce(F.bool_or("verified"), F.lit(False)).alias("v"))
    return found.select("record_id", "outcome", "events", "tasks", (F.col("v") | (F.col("tasks") >= CONFIRMED_BY)).alias("stable"))


def usage_summary(events: DataFrame, outcomes: list[str]) -> DataFrame:
    """One row a record: events, how many of each outcome, and the most frequent one (of equals the last by name)."""
    counts = events.groupBy("record_id", "outcome").agg(F.count("*").alias("c"))
    each = [F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("c"))), F.lit(0)).alias(o) for o in outcomes]
    return counts.groupBy("record_id").agg(F.sum("c").alias("events"), *each, F.max_by("outcome", F.struct("c", "outcome")).alias("dominant"))


def misses(events: DataFrame) -> DataFrame:
    """Misses rolled up by normalised query: how many and when last."""
    from ..functions.text import normal_query

    return events.groupBy(normal_query(F.col("query")).alias("query")).agg(F.count("*").alias("miss_count"), F.max("event_id").alias("last_event"))
