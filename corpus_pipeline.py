"""From raw documents to packed training sequences: five stages, each calling one operator of gleanery.llm.

Language ID drops documents without a known language; exact dedup leaves one of equal texts; the n-gram join leaves one
of each group of near copies; personal data are replaced by their kinds; packing cuts what is left into sequences.
Each stage reads what the one before wrote. Null texts have no known language and go first. Rows are judged by their own
text, except that rows which share a doc_id are one document to the n-gram join. The last stage gives the sequences: the
contract's columns and the token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import exact_dedup, language, near, packing, pii
from gleanery.llm.common import forget, materialize, scratch
from gleanery.llm.vocabularies import vocabulary

#: Least score of a language that is trusted.
TRUSTED = 0.3
#: Bytes of an Arrow batch: Spark cuts batches before a Python worker gets them, however long the texts are.
BATCH = 4 << 20


def bounded(stage: Callable) -> Callable:
    """A stage whose batches of rows are bounded by bytes as well (the session keeps the setting, as plans run later)."""

    @wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run_bounded


@bounded
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.filter_known(docs, TRUSTED)


@bounded
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicate(docs)


@bounded
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without personal data; n_chars follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs, vocabulary("byte_bpe_50k.json")), "ids")


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact),
    ("near_dedup", near_copies),
    ("pii", personal_data),
    ("packing", packed),
]

#: SQL can express neither a learnt classifier nor a tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:  # what a stage wrote on its way is deleted with it
            after = keep(materialize(stage(spark, docs, sf_dir)))
        if i:
            forget(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
