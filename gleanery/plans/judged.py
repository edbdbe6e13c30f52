"""Quality, trust, fusion, selections, conflicts and governance bound to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conflicts, scoring, selection
from ..sources.records import table
from . import views
from .bound import query
from .recall import sql_tokens
from .views import EXPERIENCE_SQL, FEEDBACK_SQL

# --- quality ---------------------------------------------------------------------------------------------------------

_QUALITY = f"""floor(greatest(0, least(1, CAST(
    0.20 * 0.85 + 0.25 * least(1.0, 0.25 + CASE WHEN evidence IS NOT NULL OR verification_method IS NOT NULL OR source_case IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN source_case IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN anchor_key IS NOT NULL THEN 0.15 ELSE 0 END)
    + 0.20 * CASE WHEN is_stale OR status = 'stale' THEN 0.2 ELSE confidence END + 0.15 * greatest(0, least(1, 1.0 - misleading - CASE WHEN superseded_by IS NOT NULL THEN 0.25 ELSE 0 END))
    + 0.10 * CASE WHEN reuse_feedback IS NULL THEN 0.35 WHEN contains(lower(reuse_feedback), 'helped') THEN 0.85 ELSE 0.45 END
    + 0.10 * least(1.0, 0.35 + CASE WHEN trigger_condition IS NOT NULL AND repair_action IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN scope IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN lesson IS NOT NULL THEN 0.2 ELSE 0 END) AS DOUBLE))) * 1000.0 + 0.5 + 1e-7) / 1000.0"""
_TIER = "CASE WHEN status IN ('stale', 'archived', 'merged', 'rejected') OR is_stale THEN 'archive_candidate' WHEN use_count >= 3 THEN 'hot' WHEN use_count = 0 AND (confidence < 0.5 OR quality < 0.45) THEN 'cold' ELSE 'warm' END"
_DEPRECATED = "(status IN ('stale', 'archived', 'merged', 'rejected') OR is_stale OR superseded_by IS NOT NULL OR coalesce(last_outcome, '') = 'misleading' OR misleading >= 0.5)"
_REUSED = "((use_count > 0 AND coalesce(last_outcome, '') <> 'misleading') OR coalesce(contains(lower(reuse_feedback), 'helped'), false))"
_ANCHORED = "(verification_method IS NOT NULL AND (source_case IS NOT NULL OR evidence IS NOT NULL OR anchor_key IS NOT NULL))"
_MATURITY_SCORE = f"""CASE WHEN {_DEPRECATED} THEN 0.18 ELSE floor(least(1, CAST(0.15 + 0.04 + {' + '.join(f"CASE WHEN {c} IS NOT NULL THEN {v} ELSE 0 END" for c, v in (("scope", 0.06), ("trigger_condition", 0.12), ("repair_action", 0.12), ("verification_method", 0.18), ("source_case", 0.16), ("evidence", 0.10), ("anti_pattern", 0.08)))}
    + CASE WHEN {_REUSED} THEN 0.18 ELSE 0 END AS DOUBLE)) * 1000.0 + 0.5 + 1e-7) / 1000.0 END"""
_LEVEL = f"CASE WHEN {_DEPRECATED} THEN 'deprecated_pattern' WHEN skill_candidate AND {_REUSED} AND {_ANCHORED} THEN 'skill_candidate' WHEN {_REUSED} AND {_ANCHORED} THEN 'reused_pattern' WHEN {_ANCHORED} THEN 'verified_case' WHEN trigger_condition IS NOT NULL AND repair_action IS NOT NULL OR score >= 0.55 THEN 'structured_candidate' ELSE 'raw_observation' END"
_SCORED = f"(SELECT *, {_LEVEL} AS level FROM (SELECT *, {_QUALITY} AS quality, {_MATURITY_SCORE} AS score FROM {EXPERIENCE_SQL}))"


def scored(s, d) -> DataFrame:
    level, score = scoring.maturity()
    return views.experiences(s, d).withColumns({"quality": scoring.experience_quality(), "level": level, "score": score})


@query("ql01_experience_quality", f"SELECT id, CAST(quality AS DOUBLE) AS quality FROM {_SCORED}")
def _(s, d):
    return scored(s, d).select("id", "quality")


@query("ql02_fact_quality", """SELECT doc_id, floor((0.20 * 0.75 + 0.25 * least(1.0, 0.25 + CASE WHEN source = 'src1' THEN 0 ELSE 0.25 END) + 0.20 * coalesce(quality, 1) * 0.8 + 0.15 * 0.85 + 0.10 * 0.5 + 0.10 * (0.4 + 0.25 + 0.2)) * 1000.0 + 0.5 + 1e-7) / 1000.0 AS quality
    FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL AND trim(text) <> '' AND lang IS NOT NULL""")
def _(s, d):
    docs = table(s, d, "documents").where("text is not null and trim(text) <> '' and lang is not null").join(table(s, d, "labels"), "doc_id", "left")
    facts = docs.selectExpr("doc_id", "lang AS category", "lang AS scope", "text AS fact", "CASE WHEN source = 'src1' THEN 'manual' ELSE source END AS source", "CAST(NULL AS STRING) AS evidence", "coalesce(quality, 1) * 0.8D AS confidence", "'active' AS status", "false AS is_stale")
    return facts.select("doc_id", scoring.fact_quality().alias("quality"))


@query("ql03_incident_quality", """SELECT event_id, floor(CAST(0.20 * 0.8 + 0.25 * CASE event_type WHEN 'error' THEN 0.1 WHEN 'click' THEN 0.35 WHEN 'view' THEN 0.65 ELSE 0.95 END + 0.20 * least(1, value / 100.0) + 0.15 * CASE event_type WHEN 'error' THEN 0.35 ELSE 0.85 END
    + 0.10 * CASE WHEN event_type IN ('error', 'click', 'view') THEN 0.35 ELSE 0.85 END + 0.10 * (0.3 + 0.15 + CASE WHEN user_id % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN user_id % 5 = 0 THEN 0.2 ELSE 0 END) AS DOUBLE) * 1000.0 + 0.5 + 1e-7) / 1000.0 AS quality FROM events""")
def _(s, d):
    told = table(s, d, "events").selectExpr("event_id", "event_type AS scene", "props AS symptom", "CASE WHEN user_id % 2 = 0 THEN 'x' END AS diagnosis", "CASE WHEN user_id % 3 = 0 THEN 'x' END AS intervention", "CASE WHEN user_id % 5 = 0 THEN 'x' END AS verification", "least(1, value / 100) AS confidence",
        "CASE event_type WHEN 'error' THEN 'legacy_unverified' WHEN 'click' THEN 'reported' WHEN 'view' THEN 'supported' ELSE 'verified' END AS state")
    return told.select("event_id", scoring.incident_quality(F.col("state")).alias("quality"))


@query("ql04_evidence_profile", f"""SELECT id, concat_ws(',', CASE WHEN evidence IS NULL AND verification_method IS NULL AND source_case IS NULL THEN 'evidence' END, CASE WHEN trigger_condition IS NULL AND scope IS NULL THEN 'applicability' END,
    CASE WHEN anti_pattern IS NULL THEN 'counter_evidence' END, CASE WHEN verification_method IS NULL THEN 'verification_method' END) AS missing FROM {EXPERIENCE_SQL}""")
def _(s, d):
    return views.experiences(s, d).select("id", F.array_join(scoring.missing_evidence(), ",").alias("missing"))


@query("ql05_maturity", f"SELECT id, level, CAST(score AS DOUBLE) AS score FROM {_SCORED}")
def _(s, d):
    return scored(s, d).select("id", "level", "score")


@query("ql06_evidence_chain", """WITH l AS (SELECT o_orderkey, count(l_orderkey) AS links FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY 1)
    SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0.0 WHEN max(o_orderkey) IS NULL THEN 0.35 WHEN sum(links) > 0 AND bool_or(o_orderstatus = 'F') THEN 1.0 WHEN sum(links) > 0 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS score
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l USING (o_orderkey) GROUP BY c_custkey""")
def _(s, d):
    links = table(s, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("links"))
    traces = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus").join(links, "o_orderkey", "left")
    told = table(s, d, "customer").select("c_custkey").join(traces, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("traces"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.bool_or(F.col("o_orderstatus") == "F"), F.lit(False)).alias("resolved"))
    score = F.when(F.col("c_custkey") % 7 == 0, 0.0).when(F.col("traces") == 0, 0.35).when((F.col("links") > 0) & F.col("resolved"), 1.0).when(F.col("links") > 0, 0.8).otherwise(0.6)
    return told.select("c_custkey", score.alias("score"))


@query("ql07_memory_tiers", f"""SELECT id, tier, floor(CASE tier WHEN 'archive_candidate' THEN 80 + (1.0 - least(confidence, quality)) * 10 WHEN 'cold' THEN 55 + (1.0 - least(confidence, quality)) * 20 WHEN 'hot' THEN 45.0 + least(use_count, 10) * 2 ELSE 30.0 END * 1000.0 + 0.5 + 1e-7) / 1000.0 AS priority FROM (SELECT *, {_TIER} AS tier FROM {_SCORED})""")
def _(s, d):
    told = scored(s, d).withColumn("tier", scoring.tier(F.col("quality")))
    return told.select("id", "tier", scoring.tier_priority(F.col("tier"), F.col("quality")).alias("priority"))


@query("ag27_memory_tier_counts", f"SELECT tier, count(*) AS records FROM (SELECT *, {_TIER} AS tier FROM {_SCORED}) GROUP BY tier")
def _(s, d):
    return scored(s, d).groupBy(scoring.tier(F.col("quality")).alias("tier")).agg(F.count("*").alias("records"))


@query("ag26_quality_lists", f"""WITH q AS {_SCORED} (SELECT 'weakest' AS list, id, CAST(quality AS DOUBLE) AS quality FROM q WHERE quality < 0.6 ORDER BY quality, id LIMIT 10) UNION ALL (SELECT 'strongest', id, CAST(quality AS DOUBLE) FROM q WHERE quality >= 0.7 ORDER BY quality DESC, id LIMIT 10)""")
def _(s, d):
    told = scored(s, d).select("id", "quality")
    weak = told.where("quality < 0.6").orderBy("quality", "id").limit(10).withColumn("list", F.lit("weakest"))
    return weak.unionByName(told.where("quality >= 0.7").orderBy(F.desc("quality"), "id").limit(10).withColumn("list", F.lit("strongest")))


_LIKE_SOURCE = "coalesce(starts_with(source_case, 'file:'), false)"
_TRUST = f"""floor(greatest(0, least(1, CASE WHEN source_case IS NOT NULL AND NOT {_LIKE_SOURCE} THEN least(t, 0.68) ELSE t END)) * 1000.0 + 0.5 + 1e-7) / 1000.0"""
_TRUSTED = f"""(SELECT *, {_TRUST} AS trust FROM (SELECT *, CAST(0.45 + (confidence - 0.5) * 0.35 + (quality - 0.5) * 0.35 + CASE WHEN evidence IS NOT NULL OR source_case IS NOT NULL THEN 0.16 ELSE 0 END + CASE WHEN verification_method IS NOT NULL THEN 0.14 ELSE 0 END
    + CASE WHEN {_LIKE_SOURCE} THEN 0.10 WHEN source_case IS NOT NULL THEN 0.03 ELSE 0 END - CASE WHEN level IN ('verified_case', 'reused_pattern', 'skill_candidate') AND anti_pattern IS NULL THEN 0.06 ELSE 0 END
    - CASE WHEN status IN ('stale', 'archived', 'merged', 'rejected') OR is_stale THEN 0.35 ELSE 0 END + CASE level WHEN 'verified_case' THEN 0.08 WHEN 'reused_pattern' THEN 0.12 WHEN 'skill_candidate' THEN 0.16 WHEN 'raw_observation' THEN -0.10 WHEN 'deprecated_pattern' THEN -0.30 ELSE 0 END
    - least(0.25, misleading * 0.25) AS DOUBLE) AS t FROM {_SCORED}))"""
_TRUST_LEVEL = "CASE WHEN status IN ('stale', 'archived', 'merged', 'rejected') OR is_stale THEN 'possibly_stale' WHEN experience_type IN ('correction_experience', 'semantic_patch_experience') OR misleading >= 0.5 THEN 'conflict_warning' WHEN trust >= 0.75 AND verification_method IS NOT NULL THEN 'verified_experience' WHEN trust < 0.45 THEN 'weak_hint' ELSE 'usable_hint' END"


def trusted(s, d) -> DataFrame:
    told = scored(s, d)
    trust, level = scoring.trust(F.col("quality"), F.col("level"), F.lit(0.0))
    return told.withColumns({"trust": trust, "trust_level": level})


@query("rk26_trust", f"SELECT id, CAST(trust AS DOUBLE) AS trust, {_TRUST_LEVEL} AS trust_level FROM {_TRUSTED}")
def _(s, d):
    return trusted(s, d).select("id", "trust", "trust_level")


@query("ev02_calibration_cases", f"SELECT count(*) AS cases, count(*) FILTER (trust >= 0.5) AS met, CAST(count(*) FILTER (trust_level = 'conflict_warning' AND trust >= 0.8) AS BIGINT) AS overtrusted FROM (SELECT *, {_TRUST_LEVEL} AS trust_level FROM {_TRUSTED}) WHERE verification_method IS NOT NULL")
def _(s, d):
    cases = trusted(s, d).where("verification_method is not null")
    return cases.agg(F.count("*").alias("cases"), F.count_if(F.col("trust") >= 0.5).alias("met"), F.count_if((F.col("trust_level") == "conflict_warning") & (F.col("trust") >= 0.8)).alias("overtrusted"))


# --- evidence --------------------------------------------------------------------------------------------------------

ITEM = {
    "id": "event_id", "source": "CASE event_type WHEN 'error' THEN 'log' WHEN 'click' THEN 'code' WHEN 'view' THEN 'edge' WHEN 'purchase' THEN 'reflection' ELSE 'semantic' END",
    "authority": "CASE event_type WHEN 'error' THEN 'code_log_anchor' WHEN 'click' THEN 'current_source' WHEN 'view' THEN 'graph_relation' WHEN 'purchase' THEN 'verified_experience' ELSE 'advisory_memory' END",
    "score": "value", "trust": "(user_id % 10) / 10.0", "anchor": "CASE WHEN user_id % 4 > 0 THEN concat('a', event_id % 400) END", "complete": "0.8", "age_days": "CASE WHEN user_id % 5 > 0 THEN user_id * 4 END",
}
ITEMS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in ITEM.items()) + ", user_id, value FROM events)"
_GOAL = {"log": 1.0, "code": 0.9, "edge": 0.85, "reflection": 0.65, "semantic": 0.55}
_AUTH = {"code_log_anchor": 0.88, "current_source": 1.0, "graph_relation": 0.9, "verified_experience": 0.75, "advisory_memory": 0.45}
_case = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " END"
FUSED_SQL = f"""(SELECT *, CASE WHEN authority IN ('current_source', 'code_log_anchor', 'graph_relation') AND final_score >= 55 THEN 'direct' WHEN authority = 'verified_experience' OR final_score >= 60 THEN 'supporting' ELSE 'advisory' END AS tier FROM (
    SELECT *, least(100.0, greatest(0.0, round(CAST(score / best * 32.0 + {_case('source', _GOAL)} * 18.0 + {_case('authority', _AUTH)} * 18.0 + trust * 12.0 + CASE WHEN source = 'edge' THEN 1.0 ELSE least(1.0, coalesce(others, 0) / 2.0) END * 10.0 + complete * 5.0
    + CASE WHEN age_days IS NULL THEN CASE WHEN source IN ('code', 'log', 'edge') THEN 0.6 ELSE 0.4 END WHEN age_days <= 30 THEN 1.0 WHEN age_days <= 180 THEN 0.75 WHEN age_days <= 365 THEN 0.5 ELSE 0.25 END * 5.0 AS DOUBLE), 6))) AS final_score
    FROM (SELECT *, max(score) OVER (PARTITION BY source) AS best, CASE WHEN anchor IS NOT NULL THEN count(*) OVER (PARTITION BY anchor) - 1 END AS others FROM {ITEMS_SQL})))"""


def items(s, d) -> DataFrame:
    return table(s, d, "events").selectExpr(*(f"{v} AS {k}" for k, v in ITEM.items()), "user_id", "value")


@query("rk27_evidence_fusion", f"SELECT id, source, CAST(final_score AS DOUBLE) AS final_score, tier FROM {FUSED_SQL}")
def _(s, d):
    return scoring.fused(items(s, d), "diagnosis").select("id", "source", "final_score", "tier")


@query("rk28_evidence_tiers", f"SELECT tier, count(*) AS items, count(DISTINCT source) AS sources FROM {FUSED_SQL} GROUP BY tier")
def _(s, d):
    return scoring.fused(items(s, d), "diagnosis").groupBy("tier").agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"))


@query("tk07_source_caps", f"SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY value DESC, id) AS r FROM {ITEMS_SQL}) WHERE r <= {_case('source', scoring.SOURCE_CAPS)} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, id) <= 12")
def _(s, d):
    return selection.capped(items(s, d).select("user_id", "id", "source", "value"), "user_id", [F.desc("value"), F.col("id")], {"source": scoring.SOURCE_CAPS}, 12).select("user_id", "id")


@query("tk06_diverse", """WITH RECURSIVE r AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS i FROM events),
    w AS (SELECT event_type, 0 AS i, CAST([] AS BIGINT[]) AS chosen, CAST([] AS BIGINT[]) AS users FROM events GROUP BY event_type UNION ALL
        SELECT w.event_type, r.i, CASE WHEN ok THEN list_append(chosen, event_id) ELSE chosen END, CASE WHEN ok THEN list_append(users, r.user_id) ELSE users END
        FROM w JOIN (SELECT * FROM r WHERE i <= 60) r ON r.event_type = w.event_type AND r.i = w.i + 1, LATERAL (SELECT NOT list_contains(users, r.user_id) AND len(chosen) < 10 AS ok))
    SELECT event_type, unnest(chosen) AS event_id FROM w QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY i DESC) = 1""")
def _(s, d):
    events = table(s, d, "events").select("event_type", "event_id", "value", F.array(F.col("user_id").cast("string")).alias("tokens"), "user_id")
    return selection.diverse(events, "event_type", [F.desc("value"), F.col("event_id")], "tokens", "user_id", most=10, pool=60).select("event_type", "event_id")


@query("tk08_reserved", """WITH r AS (SELECT user_id, event_id, event_type = 'signup' AS special, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, special ORDER BY i) AS nth FROM r)
    SELECT user_id, event_id FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN special AND nth <= 2 THEN 0 ELSE 1 END, i) <= 5""")
def _(s, d):
    events = table(s, d, "events").select("user_id", "event_id", "event_type", "value")
    return selection.with_reserved(events, "user_id", [F.desc("value"), F.col("event_id")], F.col("event_type") == "signup", 2, 5).select("user_id", "event_id")


@query("tk12_paths_per_entry", """WITH t AS (SELECT user_id, event_id, event_type, value, max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS known FROM events),
    e AS (SELECT * FROM t WHERE event_type <> 'error' OR known = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 2)
    SELECT user_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5""")
def _(s, d):
    events = table(s, d, "events").select("user_id", "event_id", "event_type", "value")
    return selection.best_paths(events, "user_id", "event_type", F.col("event_type") != "error", [F.desc("value"), F.col("event_id")]).select("user_id", "event_id")


@query("tk01_lane_order", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY coalesce(CASE WHEN user_id % 2 = 0 THEN value * 2 END, value) DESC, ts DESC, event_id) AS place FROM events")
def _(s, d):
    order = [F.desc(F.coalesce(F.when(F.col("user_id") % 2 == 0, F.col("value") * 2), F.col("value"))), F.desc("ts"), F.col("event_id")]
    return table(s, d, "events").select("event_type", "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(*order)).cast("long").alias("place"))


@query("tk10_files_per_folder", """SELECT url, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY length(html) DESC, page_id) AS r FROM (SELECT url, page_id, html, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)) ORDER BY r > 2, length(html) DESC, page_id LIMIT 40""")
def _(s, d):
    pages = table(s, d, "pages").select("url", "page_id", F.length("html").alias("n"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    ranked = pages.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "page_id")))
    return ranked.orderBy(F.col("r") > 2, F.desc("n"), "page_id").limit(40).select("url", "page_id")


@query("tk13_many_keys", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice, p_type, p_name DESC, p_brand, p_partkey) AS place FROM part ORDER BY p_size DESC, p_retailprice, p_type, p_name DESC, p_brand, p_partkey LIMIT 25")
def _(s, d):
    keys = [F.desc("p_size"), F.col("p_retailprice"), F.col("p_type"), F.desc("p_name"), F.col("p_brand"), F.col("p_partkey")]
    best = table(s, d, "part").orderBy(*keys).limit(25)
    return best.select("p_partkey", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))


@query("tk15_learning_queue", f"""SELECT queue, id, priority FROM (
    (SELECT 'cold' AS queue, CAST(id AS VARCHAR) AS id, 1 - CAST(quality AS DOUBLE) AS priority FROM {_SCORED} WHERE quality < 0.55 ORDER BY priority DESC, id DESC LIMIT 10)
    UNION ALL (SELECT 'miss', CAST(record_id AS VARCHAR), count(*) / 1000.0 AS p FROM {FEEDBACK_SQL} WHERE outcome = 'misleading' GROUP BY record_id ORDER BY p DESC, CAST(record_id AS VARCHAR) DESC LIMIT 10)
    UNION ALL (SELECT 'unlabelled', CAST(doc_id AS VARCHAR), n_chars / 100000.0 AS p FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY p DESC, CAST(doc_id AS VARCHAR) DESC LIMIT 10)) ORDER BY priority DESC, queue DESC, id DESC LIMIT 10""".replace("priority DESC, id DESC LIMIT 10)", "priority DESC, CAST(id AS VARCHAR) DESC LIMIT 10)"))
def _(s, d):
    miss = views.feedback(s, d).where("outcome = 'misleading'").groupBy(F.col("record_id").alias("id")).agg((F.count("*") / 1000.0).alias("priority"))
    docs = table(s, d, "documents").select("doc_id", "n_chars").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 100000.0).alias("priority"))
    return selection.queue({"cold": scored(s, d).where("quality < 0.55").select("id", (1 - F.col("quality")).alias("priority")), "miss": miss, "unlabelled": docs}, 10)


@query("so07_least_depth", "SELECT p_name, min(p_size) AS depth, arg_min(p_partkey, (p_size, p_partkey)) AS id FROM part GROUP BY p_name")
def _(s, d):
    return selection.keep_best(table(s, d, "part"), ["p_name"], [F.col("p_size"), F.col("p_partkey")]).select("p_name", F.col("p_size").alias("depth"), F.col("p_partkey").alias("id"))


@query("so09_distinct_relations", "SELECT DISTINCT l_partkey AS source, l_returnflag AS relation FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("relation")).dropDuplicates()


# --- conflicts and governance ----------------------------------------------------------------------------------------

_words = sql_tokens
_jac = lambda a, b: f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


@query("ql09_near_duplicates", f"""WITH p AS (SELECT p_partkey AS id, list_distinct({_words("p_name || ' ' || p_brand || ' ' || p_type")}) AS t FROM part WHERE p_partkey < 2000)
    SELECT a.id AS id_a, b.id AS id_b, round({_jac('a.t', 'b.t')}, 6) AS similarity FROM p a JOIN p b ON a.id < b.id WHERE {_jac('a.t', 'b.t')} >= 0.8""")
def _(s, d):
    named = table(s, d, "part").where("p_partkey < 2000").select(F.col("p_partkey").alias("id"), T.tokens(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("t"))
    return conflicts.similar_pairs(named, "id", "t", 0.8)


@query("jn12_similar_parts", f"""WITH p AS (SELECT p_partkey AS id, list_distinct({_words("p_name || ' ' || p_type")}) AS t FROM part WHERE p_partkey < 250)
    SELECT a.id AS id_a, b.id AS id_b, round({_jac('a.t', 'b.t')}, 6) AS similarity FROM p a JOIN p b ON a.id < b.id WHERE {_jac('a.t', 'b.t')} >= 0.45""")
def _(s, d):
    told = table(s, d, "part").where("p_partkey < 250").select(F.col("p_partkey").alias("id"), T.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    return conflicts.similar_pairs(told, "id", "t", 0.45)


@query("ql10_conflicting_procedures", f"""WITH e AS (SELECT *, list_distinct({_words('trigger_condition')}) AS t, list_distinct({_words('scope')}) AS s, list_distinct({_words('repair_action')}) AS r FROM {EXPERIENCE_SQL} WHERE trigger_condition IS NOT NULL AND repair_action IS NOT NULL AND scope IS NOT NULL AND experience_type <> 'semantic_patch_experience')
    SELECT a.id AS older, b.id AS newer FROM e a JOIN e b ON a.id < b.id AND a.experience_type = b.experience_type WHERE {_jac('a.t', 'b.t')} >= 0.8 AND {_jac('a.s', 'b.s')} >= 0.5 AND {_jac('a.r', 'b.r')} < 0.75 AND a.repair_action <> b.repair_action""")
def _(s, d):
    return conflicts.conflicting_procedures(views.experiences(s, d))


@query("ql10_conflicting_values", f"""SELECT anchor_key, semantic_field, older, id AS newer FROM (SELECT *, lag(id) OVER w AS older, lag(proposed_value) OVER w AS before FROM {EXPERIENCE_SQL} WHERE proposed_value IS NOT NULL WINDOW w AS (PARTITION BY anchor_key, semantic_field ORDER BY id)) WHERE before <> proposed_value""")
def _(s, d):
    return conflicts.conflicting_values(views.experiences(s, d), ["anchor_key", "semantic_field"], "proposed_value")


@query("ql11_interference", f"SELECT id FROM {EXPERIENCE_SQL} WHERE last_outcome = 'misleading' OR misleading >= 0.6 OR (misleading > 0 AND use_count >= 3)")
def _(s, d):
    return conflicts.interference(views.experiences(s, d)).select("id")


_FIELDS = ("scope", "trigger_condition", "repair_action", "verification_method", "source_case", "evidence", "lesson")


@query("ql12_completeness", f"SELECT id, concat_ws(',', {', '.join(f'''CASE WHEN {c} IS NULL THEN 'missing_{c}' END''' for c in _FIELDS)}, CASE WHEN len({_words('lesson')}) <= 2 AND lesson IS NOT NULL THEN 'generic_lesson' END) AS issues FROM {EXPERIENCE_SQL}")
def _(s, d):
    issues = [F.when(~scoring.has(c), f"missing_{c}") for c in _FIELDS] + [F.when(scoring.has("lesson") & (F.size(T.tokens(F.col("lesson"))) <= 2), "generic_lesson")]
    return views.experiences(s, d).select("id", F.concat_ws(",", *issues).alias("issues"))


@query("ql13_action_priority", f"""SELECT id, floor(least(1, CAST(0.05 + CASE WHEN misleading >= 0.4 THEN 0.75 WHEN use_count > 2 THEN 0.5 ELSE 0.25 END + 0.12 + 0.12 + 0.08 + CASE WHEN quality > 0 THEN least(0.25, quality * 0.25) ELSE 0 END + CASE tier WHEN 'archive_candidate' THEN 0.08 WHEN 'cold' THEN 0.04 ELSE 0 END + CASE WHEN use_count >= 2 THEN least(0.12, use_count * 0.03) ELSE 0 END AS DOUBLE)) * 1000.0 + 0.5 + 1e-7) / 1000.0 AS priority
    FROM (SELECT *, {_TIER} AS tier FROM {_SCORED})""")
def _(s, d):
    told = scored(s, d).withColumn("tier", scoring.tier(F.col("quality")))
    risk = F.when(F.col("misleading") >= 0.4, "high").when(F.col("use_count") > 2, "medium").otherwise("low")
    return told.select("id", scoring.action_priority(risk, F.lit("memory_tiers"), F.lit("review_memory_tier"), F.lit(True), F.col("quality"), F.col("tier"), F.col("use_count")).alias("priority"))


@query("tk14_top_actions", f"SELECT id, CAST(quality AS DOUBLE) AS quality FROM {_SCORED} WHERE experience_type = 'procedure_experience' ORDER BY quality, id LIMIT 10")
def _(s, d):
    return scored(s, d).where("experience_type = 'procedure_experience'").orderBy("quality", "id").limit(10).select("id", "quality")


@query("ql15_scope_health", """SELECT o_custkey, CASE WHEN n = 0 THEN 'missing' WHEN n > 25 THEN 'overflow' WHEN late >= 5 THEN 'high' WHEN late >= 1 THEN 'drift' ELSE 'stable' END AS health FROM (SELECT c_custkey AS o_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'P') AS late FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def _(s, d):
    told = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "left").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("late"))
    return told.select("o_custkey", F.when(F.col("n") == 0, "missing").when(F.col("n") > 25, "overflow").when(F.col("late") >= 5, "high").when(F.col("late") >= 1, "drift").otherwise("stable").alias("health"))


@query("ql16_merge_conflicts", "SELECT a.doc_id, a.lang AS held, b.lang AS incoming FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.lang IS NOT NULL AND b.lang IS NOT NULL AND a.lang <> b.lang")
def _(s, d):
    held = table(s, d, "documents").select("doc_id", F.col("lang").alias("held"))
    incoming = table(s, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("incoming"))
    return held.join(incoming, "doc_id").where("held <> incoming")


@query("ql17_coverage_states", """SELECT p_partkey, CASE WHEN n IS NULL THEN 'uncovered' WHEN shipped = 0 THEN 'claimed' WHEN returned = 0 THEN 'supported' ELSE 'verified' END AS state FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS shipped, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem WHERE l_quantity > 40 GROUP BY 1) USING (p_partkey)""")
def _(s, d):
    claims = table(s, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("shipped"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    told = table(s, d, "part").select("p_partkey").join(claims, "p_partkey", "left")
    return told.select("p_partkey", F.when(F.col("n").isNull(), "uncovered").when(F.col("shipped") == 0, "claimed").when(F.col("returned") == 0, "supported").otherwise("verified").alias("state"))


@query("ag21_strategy_clusters", f"SELECT name, count(*) AS records, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes, count(*) FILTER (last_outcome = 'misleading') AS misleading FROM (SELECT *, replace(lower(repair_action), ' ', '-') AS name FROM {EXPERIENCE_SQL} WHERE repair_action IS NOT NULL) GROUP BY name HAVING count(*) >= 2")
def _(s, d):
    told = views.experiences(s, d).where("repair_action is not null").withColumn("name", F.replace(F.lower("repair_action"), F.lit(" "), F.lit("-")))
    clusters = told.groupBy("name").agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set("scope")), ",").alias("scopes"), F.count_if(F.coalesce(F.col("last_outcome"), F.lit("")) == "misleading").alias("misleading"))
    return clusters.where("records >= 2").withColumn("scopes", F.when(F.col("scopes") != "", F.col("scopes")))


@query("ag22_fingerprint_clusters", f"SELECT concat(scope, ':', array_to_string({_words('trigger_condition')}[1:3], '-')) AS fingerprint, count(*) AS records FROM {EXPERIENCE_SQL} WHERE scope IS NOT NULL AND trigger_condition IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def _(s, d):
    told = views.experiences(s, d).where("scope is not null and trigger_condition is not null")
    key = F.concat("scope", F.lit(":"), F.array_join(F.slice(T.tokens(F.col("trigger_condition")), 1, 3), "-"))
    return told.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("records")).where("records >= 2")


@query("ag24_skill_patterns", f"SELECT scope, count(*) AS complete FROM {EXPERIENCE_SQL} WHERE skill_candidate AND trigger_condition IS NOT NULL AND repair_action IS NOT NULL GROUP BY scope HAVING count(*) >= 2")
def _(s, d):
    return views.experiences(s, d).where("skill_candidate and trigger_condition is not null and repair_action is not null").groupBy("scope").agg(F.count("*").alias("complete")).where("complete >= 2")


@query("ag25_cluster_readiness", f"SELECT anchor_key, n, CASE WHEN n + v >= 7 THEN 'promote' WHEN n + v >= 4 THEN 'review' ELSE 'wait' END AS readiness FROM (SELECT coalesce(anchor_key, scope, '') AS anchor_key, count(*) AS n, 2 * count(verification_method) AS v FROM {EXPERIENCE_SQL} GROUP BY 1)")
def _(s, d):
    told = views.experiences(s, d).groupBy(F.coalesce("anchor_key", "scope", F.lit("")).alias("anchor_key")).agg(F.count("*").alias("n"), (2 * F.count("verification_method")).alias("v"))
    points = F.col("n") + F.col("v")
    return told.select("anchor_key", "n", F.when(points >= 7, "promote").when(points >= 4, "review").otherwise("wait").alias("readiness"))


@query("ag45_health_roll_up", f"SELECT count(*) AS records, count(*) FILTER (is_stale) AS stale, count(*) FILTER (confidence < 0.6) AS low_confidence, count(*) FILTER (verification_method IS NULL) AS unverified, count(*) FILTER (scope IS NULL) AS without_scope FROM {EXPERIENCE_SQL}")
def _(s, d):
    return views.experiences(s, d).agg(F.count("*").alias("records"), F.count_if("is_stale").alias("stale"), F.count_if(F.col("confidence") < 0.6).alias("low_confidence"), F.count_if(F.col("verification_method").isNull()).alias("unverified"), F.count_if(F.col("scope").isNull()).alias("without_scope"))


_CLAIMS = f"""(WITH c AS (SELECT item_id AS claim_id, unnest(list_distinct(list_filter({_words('text')}, lambda t: len(t) > 1))) AS term FROM benchmark), n AS (SELECT claim_id, count(*) AS n FROM c GROUP BY claim_id),
    e AS (SELECT doc_id, unnest(list_distinct({_words('text')})) AS term FROM documents), m AS (SELECT claim_id, doc_id, round(count(*) / any_value(n), 6) AS support FROM c JOIN n USING (claim_id) JOIN e USING (term) GROUP BY claim_id, doc_id)
    SELECT item_id AS claim_id, coalesce(support, 0.0) AS support, doc_id AS evidence_id, CASE WHEN coalesce(support, 0) >= 0.45 THEN 'grounded' WHEN coalesce(support, 0) >= 0.25 THEN 'weak' ELSE 'unsupported' END AS band FROM benchmark LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY support DESC, doc_id) = 1) b ON b.claim_id = item_id)"""


def _supported(s, d):
    return scoring.claim_support(table(s, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text"), table(s, d, "documents").select(F.col("doc_id").alias("evidence_id"), F.coalesce("text", F.lit("")).alias("text")))


@query("rk20_claim_support", f"SELECT * FROM {_CLAIMS}")
def _(s, d):
    return _supported(s, d)


@query("ag46_grounded_rate", f"SELECT count(*) AS claims, round(count(*) FILTER (band = 'grounded') / count(*), 6) AS grounded_rate, round(count(*) FILTER (band = 'unsupported') / count(*), 6) AS unsupported_rate FROM {_CLAIMS}")
def _(s, d):
    rate = lambda b: F.round(F.count_if(F.col("band") == b) / F.count("*"), 6)
    return _supported(s, d).agg(F.count("*").alias("claims"), rate("grounded").alias("grounded_rate"), rate("unsupported").alias("unsupported_rate"))


@query("ag35_outcome_score", """WITH o AS (SELECT o_orderkey, count(DISTINCT l_partkey) AS predicted, count(DISTINCT l_partkey) FILTER (l_partkey % 2 = 0) AS hits, bool_or(l_partkey % 7 = 0) AS forbidden, any_value(o_orderstatus) = 'F' AS category FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT o_orderkey, round(greatest(0, least(1, CAST(0.4 * CAST(category AS INTEGER) + 0.35 * least(1.0, hits / 3.0) + 0.15 * hits / predicted + 0.1 * CAST(predicted > 3 AS INTEGER) - 0.25 * CAST(forbidden AS INTEGER) AS DOUBLE))), 6) AS score FROM o""")
def _(s, d):
    joined = table(s, d, "orders").select("o_orderkey", "o_orderstatus").join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    told = joined.groupBy("o_orderkey").agg(F.countDistinct("l_partkey").alias("predicted"), F.countDistinct(F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey"))).alias("hits"), F.bool_or(F.col("l_partkey") % 7 == 0).alias("forbidden"), (F.max("o_orderstatus") == "F").alias("category"))
    score = scoring.outcome_score(F.col("category"), F.least(F.lit(1.0), F.col("hits") / 3.0), F.col("hits") / F.col("predicted"), F.col("predicted") > 3, F.col("forbidden"))
    return told.select("o_orderkey", F.round(score, 6).alias("score"))

