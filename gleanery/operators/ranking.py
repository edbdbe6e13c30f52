"""Lexical retrieval: postings, BM25 and weighted reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .tables import top_per_group

K1, B, RANK_CONSTANT = 1.2, 0.75, 60


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf, doc_len)."""
    split = docs.select(F.col(id_col).alias("doc_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).withColumn("doc_len", F.size("t"))
    return split.select("doc_id", "doc_len", F.explode("t").alias("term")).groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k: int) -> DataFrame:
    """(doc_id, score) of the k best documents for terms; only postings of these terms are made and move."""
    wanted = [t.lower() for t in dict.fromkeys(terms)]
    split = docs.select(F.col(id_col).alias("doc_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).withColumn("doc_len", F.size("t"))
    whole = split.agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean_len"))
    hits = split.select("doc_id", "doc_len", F.explode(F.filter("t", lambda x: x.isin(*wanted))).alias("term")).groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row for each term of the query
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(whole)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def fuse(rankings: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Weighted reciprocal-rank fusion of (channel, id, rank): (id, score, channels, best_rank), best first."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("channel")], F.lit(1.0))
    fused = rankings.groupBy("id").agg(
        F.round(F.sum(weight / (RANK_CONSTANT + F.col("rank"))), 9).alias("score"), F.count("*").alias("channels"), F.min("rank").cast("long").alias("best_rank")
    )
    return fused.orderBy(F.desc("score"), F.desc("channels"), "best_rank", "id").limit(k)


def normalised(df: DataFrame, source: str, score: str) -> DataFrame:
    """Scores as shares of the best of their source: maxima are combined in the tasks and joined back, one row a source."""
    best = df.groupBy(F.col(source).alias("__source")).agg(F.max(score).alias("__best"))
    joined = df.join(best, F.col(source) == F.col("__source"))
    return joined.withColumn("relevance", F.round(F.col(score) / F.col("__best"), 6)).drop("__source", "__best")


def similar_sets(df: DataFrame, id_col: str, tokens_col: str, least: float) -> DataFrame:
    """(id_a, id_b, similarity) of rows whose token sets have at least that Jaccard similarity, found by rare tokens."""
    from .conflicts import similar_pairs

    return similar_pairs(df, id_col, tokens_col, least)


def best_per(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    return top_per_group(df, [group], [F.desc(score), F.col(tie)], 1)
