"""Searching in rounds: what each round of a request adds, and where each request stops, for all requests at once.

Candidates are rows (request, round, evidence_id, source, score): what each planned round would find. No round waits for
another: what a round adds follows from the first round in which evidence occurs, and the round at which a request stops is
the least that meets a rule; evidence of later rounds is dropped. So requests need no loop, and none holds up another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import top_per_group

#: Sources that cover a goal: of each group one must have been found. Fixed values.
COVERAGE = {
    "diagnosis": (("code",), ("log", "incident")), "change_impact": (("code",), ("edge",)), "design": (("code",), ("edge",)),
    "experience_reuse": (("reflection",), ("code",)), "governance": (("reflection", "semantic"),),
}
OTHERWISE, LEAST_EVIDENCE = (("code",), ("edge", "log")), 3


def covers(goal: Column, sources: Column) -> Column:
    """Whether found sources cover a goal."""
    every = lambda groups: reduce(lambda x, y: x & y, (F.arrays_overlap(sources, F.array(*map(F.lit, g))) for g in groups))
    return reduce(lambda c, kv: c.when(goal == kv[0], every(kv[1])), COVERAGE.items(), F).otherwise(every(OTHERWISE))


def executed(candidates: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rounds that are run and the evidence that is kept.

    requests (request, goal, planned, max_rounds, novelty_threshold). A request stops after round 1 if LEAST_EVIDENCE or more
    pieces cover its goal, after a later round that adds nothing, or less than the threshold's share of what it found; else
    after its last round.

    Rounds: (request, round, candidates, added, novelty, stops, reason), reason in the last round only. Evidence: (request,
    evidence_id, source, score, round) with the best score of the rounds that are run; of equals the first round counts.
    """
    plan = requests.withColumn("__rounds", F.least("planned", "max_rounds"))
    within = candidates.join(plan.select("request", "__rounds"), "request").where(F.col("round").between(1, F.col("__rounds"))).drop("__rounds")
    first = within.groupBy("request", "evidence_id").agg(F.min("round").alias("round"), F.min_by("source", "round").alias("source"))
    added = first.groupBy("request", "round").agg(F.count("*").alias("added"), F.collect_set("source").alias("sources"))
    found = within.groupBy("request", "round").agg(F.count("*").alias("candidates"))
    rounds = plan.where("__rounds > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("__rounds").cast("int"))).alias("round"))
    rounds = rounds.join(found, ["request", "round"], "left").join(added, ["request", "round"], "left").fillna(0, ["candidates", "added"])
    share = F.col("added") / F.greatest(F.lit(1), "candidates")
    none = F.array().cast("array<string>")
    reason = (
        F.when((F.col("round") == 1) & (F.col("added") >= LEAST_EVIDENCE) & covers(F.col("goal"), F.coalesce("sources", none)), "sufficient_cross_lane_coverage")
        .when((F.col("round") > 1) & (F.col("added") == 0), "no_new_evidence")
        .when((F.col("round") > 1) & (share < F.col("novelty_threshold")), "low_novelty")
        .when(F.col("round") == F.col("__rounds"), "max_rounds")
    )
    rounds = rounds.withColumns({"reason": reason, "novelty": F.round(share, 3)})
    last = F.min(F.when(F.col("reason").isNotNull(), F.col("round"))).over(Window.partitionBy("request"))
    run = rounds.withColumn("stops", last).where(F.col("round") <= F.col("stops"))
    stops = run.select("request", "stops").distinct()
    kept = within.join(stops, "request").where(F.col("round") <= F.col("stops")).drop("stops")
    best = top_per_group(kept, ["request", "evidence_id"], [F.desc("score"), F.col("round"), F.col("source")], 1)
    return run.select("request", "round", "candidates", "added", "novelty", "stops", "reason"), best.select("request", "evidence_id", "source", "score", "round")
