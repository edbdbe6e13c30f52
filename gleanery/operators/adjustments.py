"""Feedback and usage that change the ranking of records, once they are confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .feedback import CONFIRMED_BY
from .graph import written

#: Requests that may be broadcast to their events.
BROADCAST_ROWS = 1_000_000
#: What a confirmed reason takes off a score, at full overlap with the request. Fixed values.
PENALTIES = {"weak_related": 18.0, "stale": 24.0, "wrong_domain": 24.0, "too_broad": 16.0, "misleading": 30.0, "overtrusted": 18.0}
OTHER_PENALTY, MOST_PENALTY = 12.0, 40.0
POSITIVE = ("useful", "verified_useful", "undertrusted")
#: What reasons do to the trust in a record. Fixed values.
TRUST_BONUS = {"useful": 0.08, "verified_useful": 0.16, "undertrusted": 0.12}
TRUST_PENALTY = {"overtrusted": 0.18}
MOST_TRUST = 0.3
#: What use does to a rank. Fixed values.
USE_BONUS, USE_PENALTY = {"helpful": 0.18}, {"misleading": 0.35}


def _told(values: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(other))


def confirmed_overlaps(events: DataFrame, query: str, kind: str, intrinsic: list[str]) -> DataFrame:
    """(record_id, kind, overlap): the largest overlap of a request with those of confirmed events, by record and kind.

    events: event_id, record_id, task_id, verified, query and the column `kind`. Confirmed: verified once, seen in two
    tasks, or of an intrinsic kind. Overlaps are counted once for each distinct request.
    """
    terms = lambda text: F.filter(T.query_tokens(text), lambda t: F.length(t) > 1)
    # The distinct requests are written, so that no plan carries their terms to the events.
    texts = written(events.select("query").distinct().withColumn("__terms", terms(F.col("query"))).withColumn("__wanted", terms(F.lit(query))).select("query", T.jaccard(F.col("__wanted"), F.col("__terms")).alias("__overlap")))
    texts = texts.where("__overlap > 0")
    near = events.join(F.broadcast(texts) if texts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else texts, "query")
    task = F.coalesce(F.col("task_id").cast("string"), F.concat(F.lit("legacy-event:"), F.col("event_id").cast("string")))
    grouped = near.groupBy("record_id", kind).agg(F.max("__overlap").alias("overlap"), F.countDistinct(task).alias("__tasks"), F.coalesce(F.bool_or("verified"), F.lit(False)).alias("__verified"))
    return grouped.where(F.col("__verified") | (F.col("__tasks") >= CONFIRMED_BY) | F.col(kind).isin(*intrinsic)).select("record_id", F.col(kind).alias("kind"), "overlap")


def feedback_penalties(events: DataFrame, query: str) -> DataFrame:
    """(record_id, penalty, trust_bonus, trust_penalty) of records with confirmed feedback on similar requests (events with a `reason`)."""
    found = confirmed_overlaps(events, query, "reason", ["verified_useful"])
    penalty = F.when(F.col("kind").isin(*POSITIVE), 0.0).otherwise(_told(PENALTIES, F.col("kind"), OTHER_PENALTY))
    least = lambda most, x: F.round(F.least(F.lit(most), F.sum(x * F.col("overlap"))), 6)
    return found.groupBy("record_id").agg(
        least(MOST_PENALTY, penalty).alias("penalty"), least(MOST_TRUST, _told(TRUST_BONUS, F.col("kind"), 0.0)).alias("trust_bonus"), least(MOST_TRUST, _told(TRUST_PENALTY, F.col("kind"), 0.0)).alias("trust_penalty")
    )


def usage_adjustments(events: DataFrame, query: str) -> DataFrame:
    """(record_id, bonus, penalty) from confirmed use on similar requests; only helpful and misleading outcomes count."""
    found = confirmed_overlaps(events.where(F.col("outcome").isin(*USE_BONUS, *USE_PENALTY)), query, "outcome", [])
    least = lambda values: F.round(F.least(F.lit(max(values.values())), F.sum(_told(values, F.col("kind"), 0.0) * F.col("overlap"))), 6)
    return found.groupBy("record_id").agg(least(USE_BONUS).alias("bonus"), least(USE_PENALTY).alias("penalty"))
