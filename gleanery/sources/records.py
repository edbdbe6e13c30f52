"""Readers and writers of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def project_files(spark: SparkSession, path: str, suffixes: list[str], ignored: list[str]) -> DataFrame:
    """(path, size, sha256, text) of the files below a folder that have a known suffix and lie in no ignored folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)
    found = found.where(wanted & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))))
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"))


def write_notes(df: DataFrame, path: str, title: str, body: str, kind: str) -> None:
    """One Markdown text a record, in folders by kind."""
    note = F.concat(F.lit("# "), F.coalesce(F.col(title).cast("string"), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(body).cast("string"), F.lit("")), F.lit("\n"))
    df.select(note.alias("value"), kind).write.mode("overwrite").partitionBy(kind).text(path)
