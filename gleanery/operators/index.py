"""An inverted index as a table: postings by term, fielded BM25 over it, lanes and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import B, K1, RANK_CONSTANT

#: Lanes of recall over fields, with the weight of each field. Fixed values.
LANES = {
    "file_identity_fts": {"file_path": 6.0, "identity_terms": 9.0},
    "file_semantic_fts": {"file_path": 1.0, "semantic_terms": 7.0},
    "symbol_identity_fts": {"file_path": 2.0, "symbol": 8.0, "identity_terms": 10.0},
    "symbol_semantic_fts": {"symbol": 2.0, "semantic_terms": 7.0},
    "method_body_fts": {"body_terms": 8.0},
    "string_key_fts": {"string_terms": 9.0},
    "semantic_mechanism_fts": {"mechanism_terms": 9.0},
}


#: The kinds of passages that each lane looks at, and the lanes of identities. Fixed values.
KINDS = {
    "file_identity_fts": ("file",), "file_semantic_fts": ("file",), "symbol_identity_fts": ("symbol", "callable"), "symbol_semantic_fts": ("symbol", "callable"), "method_body_fts": ("callable",), "string_key_fts": ("callable",),
    "semantic_mechanism_fts": ("symbol", "callable"),
}
IDENTITIES = ("file_identity_fts", "symbol_identity_fts")


def postings(passages: DataFrame, fields: list[str], distinct: bool = False) -> DataFrame:
    """(id, field, term, tf, doc_len) of passages (id and text fields); doc_len counts the tokens of all fields.

    Words become rows, which Spark counts within tasks before it shuffles. With `distinct`, terms of one character are
    left out and each term of a field counts once.
    """
    text = lambda f: F.coalesce(F.col(f), F.lit(""))
    doc_len = passage_length(fields).cast("long").alias("doc_len")
    each = passages.select("id", doc_len, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text(f).alias("text")) for f in fields))).alias("f"))
    found = each.select("id", "doc_len", "f.field", F.explode(T.words(F.col("f.text"))).alias("word"))
    terms = found.select("id", "doc_len", "field", F.explode(T.pieces(F.col("word"))).alias("term"))
    if distinct:
        terms = terms.where(F.length("term") > 1)
    tf = (F.lit(1) if distinct else F.count("*")).cast("long").alias("tf")
    return terms.groupBy("id", "field", "term", "doc_len").agg(tf).select("id", "field", "term", "tf", "doc_len")


def passage_length(fields: list[str]) -> Column:
    """The tokens of all fields of a passage."""
    return reduce(lambda x, y: x + y, (T.token_count(F.coalesce(F.col(f), F.lit(""))) for f in fields))


def write_index(passages: DataFrame, fields: list[str], path: str) -> None:
    """The postings sorted by term, so that a search reads only the row groups of its terms, and the lengths of all passages."""
    found = postings(passages, fields)
    found.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    passages.agg(F.count("*").alias("n"), F.avg(passage_length(fields)).alias("mean_len")).write.parquet(f"{path}/lengths")


def _among(term: Column, terms: list[str], prefix: bool) -> Column:
    return reduce(lambda x, y: x | y, (term.startswith(t) for t in terms)) if prefix else term.isin(*terms)


def matches(found: DataFrame, terms: list[str], weights: dict[str, float], prefix: bool) -> DataFrame:
    """(id, doc_len, query_term, f): the weighted hits of each term of a request (or of what begins with it) in the given fields."""
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("field")]
    own = found.where(F.col("field").isin(*weights) & _among(F.col("term"), terms, prefix))
    hit = F.filter(F.array(*map(F.lit, terms)), lambda t: F.col("term").startswith(t) if prefix else F.col("term") == t)
    return own.select("id", "doc_len", F.explode(hit).alias("query_term"), (F.col("tf") * weight).alias("f")).groupBy("id", "doc_len", "query_term").agg(F.sum("f").alias("f"))


def bm25(found: DataFrame, lengths: DataFrame, terms: list[str], weights: dict[str, float], k: int, prefix: bool = True, every: bool = False, among: DataFrame | None = None) -> DataFrame:
    """(id, score, terms) of the k best passages; with `every`, of those only that hold all terms; with `among`, of these ids.

    lengths: one row (n, mean_len). Statistics are those of all passages.
    """
    hits = matches(found, terms, weights, prefix)
    df = hits.groupBy("query_term").agg(F.count("*").alias("df"))  # a row for each term of the request
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    scored = hits.join(F.broadcast(df), "query_term").join(F.broadcast(lengths)).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("terms"))
    if every:
        scored = scored.where(F.col("terms") == len(terms))
    if among is not None:
        scored = scored.join(among.select("id"), "id", "left_semi")
    return scored.orderBy(F.desc("score"), "id").limit(k)


def lanes(found: DataFrame, lengths: DataFrame, terms: list[str], fields: dict[str, dict[str, float]], k: int) -> DataFrame:
    """(channel, id, rank) of each lane: the k best passages by its own fields."""
    out = []
    for channel, weights in fields.items():
        best = bm25(found, lengths, terms, weights, k)
        rank = F.row_number().over(_by_score())
        out.append(best.select(F.lit(channel).alias("channel"), "id", rank.cast("long").alias("rank")))
    return reduce(DataFrame.unionByName, out)


def _by_score():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), "id")  # at most k rows


def channels(found: DataFrame, lengths: DataFrame, kinds: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(channel, id, rank) of the seven LANES, each among its own kinds of passages; kinds (id, kind) of all passages.

    Lanes of identities go up to `limit` rows (8 at least, 32 at most), the others to half of that (8 to 24).
    """
    out = []
    for channel, weights in LANES.items():
        most = max(8, min(limit, 32)) if channel in IDENTITIES else max(8, min(limit // 2, 24))
        best = bm25(found, lengths, terms, weights, most, among=kinds.where(F.col("kind").isin(*KINDS[channel])))
        out.append(best.select(F.lit(channel).alias("channel"), "id", F.row_number().over(_by_score()).cast("long").alias("rank")))
    return reduce(DataFrame.unionByName, out)


def attributed(rankings: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Fused ids with the lanes that found each: (id, score, lanes), best first."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("channel")], F.lit(1.0))
    fused = rankings.groupBy("id").agg(F.round(F.sum(weight / (RANK_CONSTANT + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("lanes"), F.min("rank").alias("best_rank"))
    return fused.orderBy(F.desc("score"), "best_rank", "id").limit(k).drop("best_rank")


def prefix_coverage(found: DataFrame, terms: list[str], least: int) -> DataFrame:
    """(id, covered): passages in which at least so many terms begin a word."""
    return matches(found, terms, {f: 1.0 for f in _fields(found)}, True).groupBy("id").agg(F.countDistinct("query_term").alias("covered")).where(F.col("covered") >= least)


def _fields(found: DataFrame) -> list[str]:
    return [r["field"] for r in found.select("field").distinct().limit(1000).collect()]


def focus_coverage(text: Column, terms: list[str]) -> Column:
    """8 for each term that a text holds, 12 times the share of them, and 8 more for two or more."""
    matched = reduce(lambda x, y: x + y, (T.token_matches(F.lit(t), F.lower(text)).cast("int") for t in terms))
    return F.when(matched > 0, matched * 8.0 + matched / F.lit(len(terms)) * 12.0 + F.when(matched >= 2, 8.0).otherwise(0.0)).otherwise(F.lit(0.0))


def salience(text_tokens: Column, terms: list[str]) -> Column:
    """4 for each salient term of which a token is the beginning or that begins a token, 18 at most."""
    near = lambda t: F.exists(text_tokens, lambda w: F.when((F.length(w) < 3) | F.lit(len(t) < 3), w == t).otherwise(w.startswith(t) | F.lit(t).startswith(w)))
    return F.least(F.lit(18.0), reduce(lambda x, y: x + y, (near(t).cast("int") for t in terms)) * 4.0)


def identifier_identity(identifier: Column, terms: list[str]) -> Column:
    """A quarter of the letters (8 at most) of each longer term that an identifier holds, 6 at most in all."""
    low = F.lower(identifier)
    return F.least(F.lit(6.0), reduce(lambda x, y: x + y, [F.lit(0.0), *(F.when(low.contains(t), min(len(t), 8) / 4).otherwise(0.0) for t in dict.fromkeys(terms) if len(t) >= 4)]))


def weighted_fields(query: str, terms: list[str], expanded: list[str], weighted: dict[str, float], exact: dict[str, float]) -> list[Column]:
    """score and reasons of a row: fields that hold the whole request or that it holds, and weights for each term in a field."""
    whole = query.strip().lower()
    low = lambda f: F.lower(F.coalesce(F.col(f), F.lit("")))
    equal = {f: (F.length(low(f)) > 0) & F.lit(bool(whole)) & (low(f).contains(whole) | F.lit(whole).contains(low(f))) for f in exact}
    hits = {f: {t: T.token_matches(F.lit(t), low(f)) for t in terms} for f in weighted}
    count = {f: reduce(lambda x, y: x + y, (h.cast("int") for h in hits[f].values())) for f in weighted}
    by_expansion = {f: reduce(lambda x, y: x | y, [F.lit(False), *(hits[f][t] for t in expanded)]) for f in weighted}
    score = reduce(lambda x, y: x + y, [*(F.when(equal[f], w).otherwise(0.0) for f, w in exact.items()), *(count[f] * w for f, w in weighted.items())])
    told = [F.when(equal[f], f"exact_{f}") for f in exact] + [F.when(count[f] > 0, F.when(by_expansion[f], f"expanded_query:{f}").otherwise(f)) for f in weighted]
    return [score.alias("score"), F.array_join(F.array_compact(F.array(*told)), ",").alias("reasons")]
