"""All queries of the library by name, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import hierarchy, judged, kept, located, more, planned, recall, rescored, routes, traces, wide  # noqa: F401  register their queries
from .plans.bound import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lexical retrieval over the written index of documents."""
    return QUERIES["rk05_indexed_bm25"](spark, sf_dir).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
