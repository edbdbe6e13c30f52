"""Exact de-duplication by content-defined chunk recipes; DataFrame functions only.

A text is cut where its own content says so: after LEAST characters, behind the first space that follows one of
CUT_AFTER and one more letter, or after MOST characters. So equal passages give equal chunks wherever they stand. A
chunk's identifier is the 64-bit hash of its content and length. Texts are read and cut once; identifiers and SHA-256
digests of the chunks, 40 bytes each, are written. From them comes the dictionary of distinct chunks, which verifies that
no identifier stands for two; if one does, the digests are the identifiers. Documents are equal if their ordered lists of
identifiers are. Large groups (more than 1 of LARGE documents, so less than LARGE of them) are broadcast, and so are
their lists, which hold at most LARGE times the mean; no group gathers in one task.

Null texts count as empty, and all empty texts are equal. Rows that share a doc_id are reported with the same keep_id
if their texts are equal. A null doc_id sorts last and is kept only if its group has no other id. Other columns are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WHITE, fresh_names, materialize, named

LEAST, MOST, CUT_AFTER = 256, 2048, "bdgkmpx"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def chunks_of(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, in order; together they are the text."""
    cut = rf"(?s).{{{least},{most}}}?(?:(?<=[{CUT_AFTER}][^ ] )|\z)|.{{{most}}}|.+"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


#: Groups of more than 1 of so many documents, and of LARGE_LEAST, are joined by broadcast.
LARGE, LARGE_LEAST = 1024, 64


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, and the identifiers and digests of the chunks of each text, in order."""
    clean = docs.select("doc_id", normalised(docs["text"]).alias("text")).withColumn("chunks", chunks_of(F.col("text")))
    identifiers = F.transform("chunks", lambda c: F.xxhash64(c, F.length(c)))
    digests = F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256)))
    return clean.select("doc_id", F.sha2("text", 256).alias("text_sha256"), identifiers.alias("recipe"), digests.alias("digests"))


def dictionary(listed: DataFrame) -> DataFrame:
    """The distinct chunks of recipes: identifier, digest and how often each occurs."""
    return listed.select(F.inline(F.arrays_zip("recipe", "digests"))).groupBy("recipe", "digests").agg(F.count("*").alias("occurrences"))


def verified(listed: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and the recipe: identifiers, or digests if an identifier stands for two chunks."""
    clashes = dictionary(listed).groupBy("recipe").agg(F.count("*").alias("c")).where("c > 1")
    if clashes.isEmpty():
        return listed.drop("digests")
    return listed.select("doc_id", "text_sha256", F.col("digests").alias("recipe"))


def grouped_by_recipe(listed: DataFrame) -> DataFrame:
    """The rows of verified() with keep_id and group_size."""
    groups = listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    most = max(LARGE_LEAST, listed.count() // LARGE)
    large = F.broadcast(groups.where(F.col("group_size") > most))
    others = listed.join(large.select("recipe"), "recipe", "left_anti").join(groups.where(F.col("group_size") <= most), "recipe", "left")
    return listed.join(large, "recipe").unionByName(others)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    listed = materialize(recipes(named(docs, doc_id=id_col, text=text_col)))
    return (
        grouped_by_recipe(verified(listed))
        .select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each group of equal texts.

    Rows are told apart by id and text, so rows that share an id but not a text do not matter to each other. Of rows
    that share both, one stays.
    """
    found = materialize(exact_groups(docs, id_col, text_col).where("group_size > 1").select("doc_id", "text_sha256", "kept"))
    twice = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "text_sha256", F.lit(True).alias("twice"))
    gone = found.where("not kept").select("doc_id", "text_sha256", F.lit(False).alias("twice")).distinct()
    marked = materialize(gone.unionByName(twice))
    small = marked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = fresh_names(docs, "id", "sha", "twice")
    marked = marked.toDF(*names)
    own, sha, flag = names
    joined = docs.join(F.broadcast(marked) if small else marked, docs[id_col].eqNullSafe(F.col(own)) & (F.sha2(normalised(docs[text_col]), 256) == F.col(sha)), "left")
    once = joined.where(F.col(flag).isNull()).select(*docs.columns)
    if twice.isEmpty():
        return once
    repeated = joined.where(flag).groupBy(own, sha).agg(*(F.first(F.col(c)).alias(c) for c in docs.columns)).select(*docs.columns)
    return once.unionByName(repeated)
