"""Scores of records and evidence as column expressions: quality, maturity, tiers, trust, fusion, log signals, priorities."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of the six parts of a quality. Fixed values.
QUALITY = {"retrieval_relevance": 0.20, "evidence_strength": 0.25, "freshness": 0.20, "conflict_safety": 0.15, "reuse_success": 0.10, "governance_completeness": 0.10}
INACTIVE = ("stale", "archived", "merged", "rejected")


def thousandths(x: Column) -> Column:
    """Rounded to three places; what is a half but for the last bits goes up, alike in every engine."""
    return F.floor(x * 1000.0 + 0.5 + 1e-7) / 1000.0


def looked_up(values: dict, key: Column, other) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(other))


def has(name: str) -> Column:
    return F.coalesce(T.present(F.col(name)), F.lit(False))


def every(*names: str) -> Column:
    return reduce(lambda x, y: x & y, map(has, names))


def some(*names: str) -> Column:
    return reduce(lambda x, y: x | y, map(has, names))


def bonus(terms: Iterable[tuple[Column, float]], base: float) -> Column:
    """A base and what each condition adds."""
    return reduce(lambda x, y: x + y, (F.when(c, v).otherwise(0.0) for c, v in terms), F.lit(base))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted(parts: dict[str, Column]) -> Column:
    return thousandths(clamped(reduce(lambda x, y: x + y, (parts[k] * w for k, w in QUALITY.items()))))


def stale() -> Column:
    return F.coalesce(F.col("is_stale").cast("boolean"), F.lit(False)) | (F.coalesce("status", F.lit("active")) == "stale")


def experience_quality() -> Column:
    """Quality of an experience record."""
    feedback = F.lower(F.coalesce("reuse_feedback", F.lit("")))
    reuse = F.when(~has("reuse_feedback"), 0.35).when(feedback.rlike("success|helped|reused|pass"), 0.85).otherwise(0.45)
    return weighted({
        "retrieval_relevance": F.when(has("experience_type"), 0.85).otherwise(0.55),
        "evidence_strength": F.least(F.lit(1.0), bonus([(some("evidence", "verification_method", "source_case"), 0.25), (has("source_case"), 0.15), (every("anchor_type", "anchor_key", "semantic_field"), 0.15)], 0.25)),
        "freshness": F.when(stale(), 0.2).otherwise(F.col("confidence")),
        "conflict_safety": clamped(1.0 - F.coalesce("misleading", F.lit(0.0)) - F.when(has("superseded_by"), 0.25).otherwise(0.0)),
        "reuse_success": reuse,
        "governance_completeness": F.least(F.lit(1.0), bonus([(every("trigger_condition", "repair_action"), 0.25), (has("scope"), 0.2), (has("lesson"), 0.2)], 0.35)),
    })


def fact_quality() -> Column:
    """Quality of a fact (columns category, scope, evidence, fact, source, confidence, status, is_stale)."""
    source = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    grounded = (source != "") & ~source.isin("manual", "unknown")
    return weighted({
        "retrieval_relevance": F.when(some("category", "scope"), 0.75).otherwise(0.55),
        "evidence_strength": F.least(F.lit(1.0), bonus([(grounded, 0.25), (has("evidence"), 0.3)], 0.25)),
        "freshness": F.when(stale(), 0.2).otherwise(F.col("confidence")),
        "conflict_safety": F.lit(0.85),
        "reuse_success": F.lit(0.5),
        "governance_completeness": F.least(F.lit(1.0), bonus([(has("scope"), 0.25), (has("fact"), 0.2)], 0.4)),
    })


#: Strength of the evidence of an incident by its state. Fixed values.
INCIDENT_STATES = {"legacy_unverified": 0.1, "reported": 0.35, "supported": 0.65, "verified": 0.95}


def incident_quality(state: Column) -> Column:
    """Quality of an incident (columns scene, symptom, diagnosis, intervention, verification, confidence)."""
    return weighted({
        "retrieval_relevance": F.when(has("scene"), 0.8).otherwise(0.55),
        "evidence_strength": looked_up(INCIDENT_STATES, state, 0.1),
        "freshness": F.col("confidence"),
        "conflict_safety": F.when(state == "legacy_unverified", 0.35).otherwise(0.85),
        "reuse_success": F.when(state == "verified", 0.85).otherwise(0.35),
        "governance_completeness": F.least(F.lit(1.0), bonus([(has("symptom"), 0.15), (has("diagnosis"), 0.15), (has("intervention"), 0.15), (has("verification"), 0.2)], 0.3)),
    })


def missing_evidence() -> Column:
    """Which kinds of evidence an experience lacks."""
    lacks = {"evidence": some("evidence", "verification_method", "source_case"), "applicability": some("trigger_condition", "scope"), "counter_evidence": has("anti_pattern"), "verification_method": has("verification_method")}
    return F.array_compact(F.array(*(F.when(~c, name) for name, c in lacks.items())))


def _anchored() -> Column:
    return has("verification_method") & some("source_case", "evidence", "anchor_key")


def _reused() -> Column:
    tried = (F.col("use_count") > 0) & (F.coalesce("last_outcome", F.lit("")) != "misleading")
    return tried | F.lower(F.coalesce("reuse_feedback", F.lit(""))).rlike("reused successfully|helped|useful")


def deprecated() -> Column:
    return F.col("status").isin(*INACTIVE) | F.col("is_stale") | has("superseded_by") | (F.coalesce("last_outcome", F.lit("")) == "misleading") | (F.col("misleading") >= 0.5)


def maturity() -> tuple[Column, Column]:
    """Level and score of an experience."""
    added = [(has("experience_type"), 0.04), (has("scope"), 0.06), (has("trigger_condition"), 0.12), (has("repair_action"), 0.12), (has("verification_method"), 0.18), (has("source_case"), 0.16), (has("evidence"), 0.10), (has("anti_pattern"), 0.08), (_reused(), 0.18)]
    score = F.when(deprecated(), 0.18).otherwise(thousandths(clamped(bonus(added, 0.15))))
    level = (
        F.when(deprecated(), "deprecated_pattern")
        .when(F.col("skill_candidate") & _reused() & _anchored(), "skill_candidate")
        .when(_reused() & _anchored(), "reused_pattern")
        .when(_anchored(), "verified_case")
        .when(every("trigger_condition", "repair_action") | (score >= 0.55), "structured_candidate")
        .otherwise("raw_observation")
    )
    return level, score


def tier(quality: Column) -> Column:
    """hot, warm, cold or archive_candidate, by status, use, confidence and quality."""
    return (
        F.when(F.col("status").isin(*INACTIVE) | F.col("is_stale"), "archive_candidate")
        .when(F.col("use_count") >= 3, "hot")
        .when((F.col("use_count") == 0) & ((F.col("confidence") < 0.5) | (quality < 0.45)), "cold")
        .otherwise("warm")
    )


def tier_priority(of: Column, quality: Column) -> Column:
    doubt = 1.0 - F.least(F.col("confidence"), quality)
    return thousandths(F.when(of == "archive_candidate", 80 + doubt * 10).when(of == "cold", 55 + doubt * 20).when(of == "hot", 45.0 + F.least(F.col("use_count"), F.lit(10)) * 2).otherwise(30.0))


#: What maturity adds to trust. Fixed values.
MATURITY_TRUST = {"verified_case": 0.08, "reused_pattern": 0.12, "skill_candidate": 0.16, "raw_observation": -0.10, "deprecated_pattern": -0.30}


def trust(quality: Column, level: Column, penalty: Column) -> tuple[Column, Column]:
    """Trust score and level of an experience; source cases that are no sources cap it."""
    like_source = F.coalesce(F.lower("source_case").rlike("^(file|code|symbol|log|code_log|incident_trace|runtime_log|test|commit|pr):"), F.lit(False))
    mature = level.isin("verified_case", "reused_pattern", "skill_candidate")
    score = (
        0.45
        + (F.col("confidence") - 0.5) * 0.35
        + (quality - 0.5) * 0.35
        + bonus([(some("evidence", "source_case"), 0.16), (has("verification_method"), 0.14), (like_source, 0.10), (has("source_case") & ~like_source, 0.03), (mature & ~has("anti_pattern"), -0.06), (F.col("status").isin(*INACTIVE) | F.col("is_stale"), -0.35)], 0.0)
        + looked_up(MATURITY_TRUST, level, 0.0)
        - F.least(F.lit(0.35), penalty / 100.0)
        - F.least(F.lit(0.25), F.col("misleading") * 0.25)
    )
    capped = F.when(has("source_case") & ~like_source, F.least(score, F.lit(0.68))).otherwise(score)
    final = thousandths(clamped(capped))
    told = (
        F.when(F.col("status").isin(*INACTIVE) | F.col("is_stale"), "possibly_stale")
        .when(F.col("experience_type").isin("correction_experience", "semantic_patch_experience") | (F.col("misleading") >= 0.5), "conflict_warning")
        .when((final >= 0.75) & has("verification_method"), "verified_experience")
        .when(final < 0.45, "weak_hint")
        .otherwise("usable_hint")
    )
    return final, told


#: Authority of kinds of evidence, weights of sources for a goal, and how many items of a source are taken. Fixed values.
AUTHORITY = {"changed_source": 1.0, "current_source": 1.0, "learned_code_anchor": 0.92, "code_log_anchor": 0.88, "graph_relation": 0.9, "observed_incident": 0.85, "aggregate_evidence": 0.7, "verified_experience": 0.75, "advisory_memory": 0.45}
GOAL_WEIGHTS = {
    "design": {"code": 1.0, "edge": 1.0, "log": 0.55, "semantic": 0.5, "incident": 0.4, "reflection": 0.25, "episode": 0.2},
    "diagnosis": {"incident": 1.0, "log": 1.0, "code": 0.9, "edge": 0.85, "reflection": 0.65, "semantic": 0.55, "episode": 0.45},
    "change_impact": {"code": 1.0, "edge": 1.0, "log": 0.8, "incident": 0.7, "reflection": 0.6, "semantic": 0.55, "episode": 0.45},
    "experience_reuse": {"reflection": 1.0, "semantic": 0.8, "incident": 0.7, "code": 0.65, "log": 0.55, "edge": 0.5, "episode": 0.6},
    "governance": {"semantic": 0.9, "reflection": 1.0, "episode": 0.7, "code": 0.6, "log": 0.55, "edge": 0.6, "incident": 0.7},
    "code_understanding": {"code": 1.0, "edge": 0.9, "log": 0.75, "semantic": 0.7, "incident": 0.55, "reflection": 0.5, "episode": 0.4},
}
SOURCE_CAPS = {"reflection": 3, "semantic": 3, "episode": 2, "code": 7, "log": 5, "edge": 5, "incident": 4}


def fused(items: DataFrame, goal: str) -> DataFrame:
    """Items (id, source, authority, score, trust, anchor, complete, age_days) with final_score and tier.

    Relevance is the share of the best score of a source; support counts the other items of an anchor.
    """
    best = items.groupBy("source").agg(F.max(F.greatest("score", F.lit(0.0))).alias("best"))
    shared = items.where("anchor is not null").groupBy("anchor").agg((F.count("*") - 1).alias("others"))
    joined = items.join(F.broadcast(best), "source").join(shared, "anchor", "left")
    graph = F.when(F.col("source") == "edge", 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("others", F.lit(0)) / 2.0))
    relevance = F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)
    total = (
        relevance * 32.0
        + looked_up(GOAL_WEIGHTS[goal], F.col("source"), 0.25) * 18.0
        + looked_up(AUTHORITY, F.col("authority"), 0.4) * 18.0
        + clamped(F.col("trust")) * 12.0
        + graph * 10.0
        + F.col("complete") * 5.0
        + freshness(F.col("age_days"), F.when(F.col("source").isin("code", "log", "edge"), 0.6).otherwise(0.4)) * 5.0
    )
    final = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(total, 6)))
    return joined.withColumn("final_score", final).withColumn("tier", evidence_tier(F.col("authority"), F.col("final_score"))).select(*items.columns, "final_score", "tier")


def freshness(days: Column, unknown: Column) -> Column:
    return F.when(days.isNull(), unknown).when(days <= 30, 1.0).when(days <= 180, 0.75).when(days <= 365, 0.5).otherwise(0.25)


def evidence_tier(authority: Column, final: Column) -> Column:
    direct = authority.isin("changed_source", "current_source", "learned_code_anchor", "code_log_anchor", "graph_relation") & (final >= 55)
    return F.when(direct, "direct").when(authority.isin("observed_incident", "verified_experience") | (final >= 60), "supporting").otherwise("advisory")


#: Signals of a log event and what each counts. Fixed values.
SIGNALS = {
    "timestamp": 0.07, "process": 0.06, "level": 0.06, "logger": 0.06, "event_type": 0.07, "stage": 0.08, "business_event": 0.08, "error_code": 0.08, "reason": 0.08,
    "route_or_resource": 0.10, "request_or_session_id": 0.12, "entity_id_or_key": 0.07, "action_result": 0.08, "neighbor_context": 0.06,
}


def signals(event: DataFrame) -> dict[str, Column]:
    """Which signals an event has (columns timestamp, process, level, logger, kind, message, fields)."""
    low = F.concat(F.lit(" "), F.lower("message"), F.lit(" "))
    field = lambda *names: reduce(lambda x, y: x | y, (F.try_element_at("fields", F.lit(n)).isNotNull() for n in names))
    typed = F.col("kind") != "generic_runtime_event"
    place = field("route", "resource") | F.col("message").rlike("/[A-Za-z0-9_.-]+/")
    return {
        "timestamp": has("timestamp"), "process": has("process"), "level": has("level"), "logger": has("logger"), "event_type": typed,
        "stage": low.rlike("(stage|phase|step)=[a-z0-9_-]+| start| started| begin| failed| success"), "business_event": typed | F.col("message").rlike(r"\[[^\]]{2,40}\]"),
        "error_code": field("error_code"), "reason": field("reason"), "route_or_resource": place, "request_or_session_id": field("request_id", "session_id"),
        "entity_id_or_key": place | low.rlike("[a-z_]*(id|key)=[a-z0-9_.:/-]+"), "action_result": low.rlike("(result|outcome|status)=[a-z0-9_-]+| failed| success| succeeded| started| completed"), "neighbor_context": F.lit(False),
    }


def log_signal(event: DataFrame) -> DataFrame:
    """Events with signal_score, signal_band and the missing signals."""
    present = signals(event)
    score = thousandths(reduce(lambda x, y: x + y, (F.when(F.coalesce(present[k], F.lit(False)), w).otherwise(0.0) for k, w in SIGNALS.items())))
    missing = F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), k) for k, c in present.items()))), ",")
    return event.withColumn("signal_score", score).withColumn("signal_band", F.when(F.col("signal_score") >= 0.75, "good").when(F.col("signal_score") >= 0.55, "watch").otherwise("poor")).withColumn("missing", missing)


#: Weights of risks, lanes and actions of governance. Fixed values.
RISKS = {"high": 0.75, "medium": 0.5, "low": 0.25}
LANES = {"semantic_conflict": 0.22, "learn_semantic_repair": 0.2, "experience_conflict": 0.18, "experience_staleness": 0.18, "memory_quality": 0.16, "quality_gate": 0.16, "retrieval_feedback": 0.15, "experience_usage": 0.15, "runtime_performance": 0.14, "memory_tiers": 0.12, "log_diagnosis": 0.1, "graph_quality": 0.1, "skill_evolution": 0.08}
ACTIONS = {"review_experience_conflict": 0.22, "review_semantic_conflict": 0.2, "review_retrieval_interference": 0.18, "review_semantic_patch": 0.18, "review_runtime_performance_budget": 0.16, "review_quality_gate_failure": 0.16, "review_experience_usage": 0.15, "review_active_learning_queue": 0.14, "review_memory_tier": 0.12, "review_query_miss": 0.1}


def action_priority(risk: Column, lane: Column, action: Column, confirm: Column, priority: Column, of: Column, misses: Column) -> Column:
    added = F.when(priority > 0, F.least(F.lit(0.25), priority * 0.25)).otherwise(0.0) + F.when(of == "archive_candidate", 0.08).when(of == "cold", 0.04).otherwise(0.0) + F.when(misses >= 2, F.least(F.lit(0.12), misses * 0.03)).otherwise(0.0)
    return thousandths(F.least(F.lit(1.0), 0.05 + looked_up(RISKS, risk, 0.25) + looked_up(LANES, lane, 0.05) + looked_up(ACTIONS, action, 0.04) + F.when(confirm, 0.08).otherwise(0.0) + added))


def outcome_score(category: Column, recall: Column, precision: Column, causal: Column, forbidden: Column) -> Column:
    """How good an answer is: category, recall, precision and cause, less what it should not name."""
    return clamped(0.4 * category.cast("double") + 0.35 * recall + 0.15 * precision + 0.1 * causal.cast("double") - 0.25 * forbidden.cast("double"))


def claim_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, support, band, evidence_id): of each claim the evidence that holds the largest share of its terms.

    claims (claim_id, text) and evidence (evidence_id, text) meet by an equi-join on terms, combined in the tasks. The terms
    of claims bound what comes of it, so claims are the small side.
    """
    term = lambda df, key: df.select(key, F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda t: F.length(t) > 1))).alias("term"))
    wanted = term(claims.select("claim_id", F.col("text")), "claim_id")
    size = wanted.groupBy("claim_id").agg(F.count("*").alias("n"))
    shared = wanted.join(term(evidence.select("evidence_id", F.col("text")), "evidence_id"), "term").groupBy("claim_id", "evidence_id").agg(F.count("*").alias("shared"))
    scored = shared.join(size, "claim_id").withColumn("support", F.round(F.col("shared") / F.col("n"), 6))
    best = scored.groupBy("claim_id").agg(F.max(F.struct("support", (-F.col("evidence_id")).alias("least"))).alias("b"))
    found = claims.select("claim_id").join(best, "claim_id", "left").select("claim_id", F.coalesce("b.support", F.lit(0.0)).alias("support"), (-F.col("b.least")).alias("evidence_id"))
    return found.withColumn("band", F.when(F.col("support") >= 0.45, "grounded").when(F.col("support") >= 0.25, "weak").otherwise("unsupported"))


def first_failing(stages: list[str]) -> Column:
    """The first stage that is not true, or none."""
    return F.coalesce(*(F.when(~F.coalesce(F.col(s), F.lit(False)), s) for s in stages), F.lit("none"))
