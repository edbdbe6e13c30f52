"""Recall of incidents for many requests at once: a ranked lane over an index, a substring lane where it finds nothing.

Incidents are rows (id, FIELDS, status, capture_mode, confidence, updated_at); links (trace_id, id, score, ...). Both lanes are
joins by equality: terms meet postings, and a request that falls back meets texts by the rarest of its character trigrams, after
which the substring itself is looked for. So no request is compared with every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import written
from .ranking import B, K1
from .tables import top_per_group

#: Fields and limits. Fixed values.
FIELDS = ("symptom", "goal", "scene", "dominant_log_events", "diagnosis_summary", "causal_chain", "resolution", "intervention", "verification_evidence")
LIKE_FIELDS = ("symptom", "dominant_log_events", "diagnosis_summary", "causal_chain")
TERMS, POOL, LINKS, WEIGHT, EXACT, GRAM = 12, 3, 12, 1.2, 5.0, 3
#: Pieces of requests that may be broadcast.
BROADCAST_ROWS = 1_000_000


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where(~F.coalesce("status", F.lit("")).isin("stale", "ignored") & (F.col("capture_mode") == "agent_structured"))


def ranked(terms: DataFrame, postings: DataFrame, lengths: DataFrame, among: DataFrame, most: int) -> DataFrame:
    """(request, id, place): the rows of `among` (id) that score best by BM25 for the terms (request, term) of each request.

    postings (id, field, term, tf, doc_len) of all rows and lengths (one row: n, mean_len) give the statistics.
    """
    hits = postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").groupBy("id", "term", "doc_len").agg(F.sum("tf").alias("f"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    met = terms.join(df, "term").join(hits.join(among.select("id"), "id", "left_semi"), "term").join(F.broadcast(lengths))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    scored = met.groupBy("request", "id").agg(F.round(F.sum(part), 6).alias("bm25"))
    best = top_per_group(scored, ["request"], [F.desc("bm25"), F.col("id")], most)
    return best.select("request", "id")


def _grams(text: Column, size: Column) -> Column:
    """The distinct pieces of so many characters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size))))


def holding(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """(request, id): rows (id, list of texts) of which one holds the request (request, query), capitals or not."""
    asked = requests.select("request", F.lower(F.trim("query")).alias("query")).where("query <> ''").withColumn("size", F.least(F.lit(GRAM), F.length("query")))
    low = texts.select("id", F.explode("texts").alias("text")).where("text is not null").select("id", F.lower("text").alias("text"))
    sizes = asked.select("size").distinct()  # at most GRAM rows
    wanted = written(asked.select("request", "query", "size", F.explode(_grams(F.col("query"), F.col("size"))).alias("gram")))
    some = wanted.select("size", "gram").distinct()
    if some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    pieces = low.select("text").distinct().join(F.broadcast(sizes)).select("text", "size", F.explode(_grams(F.col("text"), F.col("size"))).alias("gram"))
    found = written(pieces.join(some, ["size", "gram"], "left_semi").distinct())  # of all pieces only those that a request has
    often = found.groupBy("size", "gram").agg(F.count("*").alias("df"))
    rarest = top_per_group(wanted.join(often, ["size", "gram"], "left").fillna(0, ["df"]), ["request"], [F.col("df"), F.col("gram")], 1)
    near = rarest.join(found, ["size", "gram"]).where(F.contains("text", "query")).select("request", "text")
    return near.join(low, "text").select("request", "id").distinct()


def recall(requests: DataFrame, incidents: DataFrame, postings: DataFrame, lengths: DataFrame, most: int) -> DataFrame:
    """(request, id, score, reasons, place): the `most` best open incidents for each request (request, query).

    The ranked lane takes the first TERMS terms of a request; a request for which it finds no open incident takes those that
    hold it as it stands, latest first. Either way POOL times as many rows as wanted are scored by their texts.
    """
    asked = requests.withColumn("__terms", T.query_tokens(F.col("query")))
    open_ = open_incidents(incidents)
    terms = asked.select("request", F.explode(F.slice(F.filter("__terms", lambda t: F.length(t) > 1), 1, TERMS)).alias("term"))
    first = written(ranked(terms, postings, lengths, open_, most * POOL))
    without = asked.join(first.select("request").distinct(), "request", "left_anti").select("request", "query")
    if without.isEmpty():
        pool = first
    else:
        held = holding(without, open_.select("id", F.array(*LIKE_FIELDS).alias("texts"))).join(open_.select("id", "updated_at"), "id")
        pool = first.unionByName(top_per_group(held, ["request"], [F.desc("updated_at"), F.desc("id")], most * POOL).select("request", "id"))
    rows = pool.join(open_, "id").join(asked, "request")
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in FIELDS)))
    rows = rows.withColumns({"__text": text, "__symptom": F.lower(F.coalesce("symptom", F.lit(""))), "__whole": F.lower(F.trim("query"))})
    hits = F.filter("__terms", lambda t: T.token_matches(t, F.col("__text")))
    plain = F.filter("__terms", lambda t: F.array_contains(T.tokens(F.col("query")), t))
    exact = (F.col("__symptom") != "") & (F.col("__whole") != "") & (F.contains("__symptom", "__whole") | F.contains("__whole", "__symptom"))
    rows = rows.withColumns({"__hits": hits, "__plain": plain, "__exact": exact})
    expanded = F.size(F.array_except("__hits", "__plain")) > 0
    reason = F.when(F.size("__hits") > 0, F.when(expanded, "expanded_query:incident_trace").otherwise("incident_trace"))
    rows = rows.withColumns({"__score": F.size("__hits") * WEIGHT + F.when(F.col("__exact"), EXACT).otherwise(0.0), "reasons": F.array_compact(F.array(F.when(F.col("__exact"), "exact_incident_symptom"), reason))})
    rows = rows.where("__score > 0").withColumn("score", F.round(F.col("__score") + F.coalesce("confidence", F.lit(0.0)), 2))
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id")))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("request", "id", "score", "reasons", "place")


def with_links(found: DataFrame, links: DataFrame, most: int = LINKS) -> DataFrame:
    """Recalled incidents with the ids of their best links, best first."""
    best = top_per_group(links.join(found.select(F.col("id").alias("trace_id")).distinct(), "trace_id", "left_semi"), ["trace_id"], [F.desc("score"), F.desc("id")], most)
    listed = best.groupBy(F.col("trace_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("id")).alias("i")))), lambda x: -x["i"]).alias("links"))
    return found.join(listed, "id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<long>")))
