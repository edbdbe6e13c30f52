"""Streams of observation events: retry-safe, and counted by sessions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package (a cluster gets it by --py-files or an image)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_each(events: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Each event key once, though senders repeat events up to `delay` late; state is dropped after that."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, by: str, time: str, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events of each key by sessions that a gap ends."""
    found = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("events"))
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote; state and output lie in the given shared folder."""
    out = f"{folder}/out"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def confirmed(events: DataFrame, group: list[str], task: str, time: str, window: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(window start, group, tasks) of signals that two tasks gave within a window: one event alone never confirms.

    Whether there are two is exact (the least and the greatest task differ), and keeps two values a window and group; how many
    there are is an estimate, which streams can keep, and exact below a few.
    """
    told = [F.min(task).alias("least"), F.max(task).alias("most"), F.greatest(F.lit(2), F.approx_count_distinct(task, 0.01)).alias("tasks")]
    found = events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *group).agg(*told).where("least <> most")
    return found.select(F.col("w.start").alias("start"), *group, "tasks")
