"""Rescoring of candidates, anchors and chains, wrapped logs, dispatch, and what else rounds off retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, logs, scoring, tables
from ..sources.records import table
from . import views
from .bound import query
from .judged import _QUALITY, ITEMS_SQL, _SCORED, items, scored
from .recall import sql_tokens
from .views import CALLS_SQL, EXPERIENCE_SQL, LINES_SQL, PATHS_SQL

TERMS = ["red", "widget", "economy"]


def _hits(column: str, terms: list[str] = TERMS) -> str:
    word = lambda t: f"regexp_matches(lower({column}), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" if len(t) <= 3 else f"contains(lower({column}), '{t}')"
    return "(" + " + ".join(f"CAST(coalesce({word(t)}, false) AS INTEGER)" for t in terms) + ")"


# --- text ------------------------------------------------------------------------------------------------------------


@query("fn07_unique_list", "SELECT * FROM (VALUES ('b|A| a |c|B', 'b|a|c'), ('', ''), ('x', 'x')) v(t, listed)")
def _(s, d):
    given = s.createDataFrame([("b|A| a |c|B",), ("",), ("x",)], "t string")
    return given.select("t", F.array_join(T.unique_list(F.split("t", r"\|")), "|").alias("listed"))


@query("fn17_severity", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0 ELSE CASE event_type WHEN 'error' THEN 17 WHEN 'view' THEN 5 WHEN 'purchase' THEN 13 ELSE 9 END END AS severity FROM events")
def _(s, d):
    return logs.parsed(views.lines(s, d)).select("event_id", logs.severity(F.col("level")).alias("severity"))


@query("fn20_domains", "SELECT event_id, CASE event_type WHEN 'error' THEN 'data' WHEN 'click' THEN 'navigation' WHEN 'view' THEN 'network' WHEN 'purchase' THEN 'general' ELSE 'session' END AS domain FROM events")
def _(s, d):
    return views.lines(s, d).select("event_id", T.domain(F.col("line")).alias("domain"))


@query("fn25_symbol_keys", "SELECT p_partkey, sha256(concat_ws(chr(10), p_type, p_name, p_brand)) AS key FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.sha2(F.concat_ws("\n", "p_type", "p_name", "p_brand"), 256).alias("key"))


@query("fn30_term_priority", f"SELECT term, count(*) AS n, any_value(CASE WHEN regexp_matches(term, '^[a-z]+[0-9]+$') THEN 3 WHEN len(term) >= 9 THEN 2 WHEN len(term) >= 5 THEN 1 ELSE 0 END) AS priority FROM (SELECT unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY term")
def _(s, d):
    term = F.col("term")
    priority = F.when(term.rlike("^[a-z]+[0-9]+$"), 3).when(F.length(term) >= 9, 2).when(F.length(term) >= 5, 1).otherwise(0)
    return table(s, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).withColumn("priority", priority)


@query("fn33_salient_tokens", "SELECT * FROM (VALUES ('see `loadUser` when it failed here now', 'loaduser load user see failed here now when it'), ('plain words', 'plain words')) v(q, terms)")
def _(s, d):
    asked = s.createDataFrame([("see `loadUser` when it failed here now",), ("plain words",)], "q string")
    return asked.select("q", F.array_join(T.salient(F.col("q")), " ").alias("terms"))


@query("tk11_bounded_tokens", "SELECT * FROM (VALUES ('alpha bb cccc dd eeeeee f_g', 'alpha bb eeeeee cccc')) v(q, terms)")
def _(s, d):
    return s.createDataFrame([("alpha bb cccc dd eeeeee f_g",)], "q string").select("q", F.array_join(T.bounded_tokens(F.col("q"), 4), " ").alias("terms"))


# --- rescoring -------------------------------------------------------------------------------------------------------


@query("rk13_fact_rescoring", f"SELECT id, round(CAST(score + confidence + 3 * quality - least(40, misleading * 20) AS DOUBLE), 6) AS rerank FROM (SELECT *, {_hits('lesson')} * 1.0 + {_hits('scope')} * 1.0 AS score, {_QUALITY} AS quality FROM {EXPERIENCE_SQL}) WHERE score > 0")
def _(s, d):
    score = index.weighted_fields("red widget economy", TERMS, [], {"lesson": 1.0, "scope": 1.0}, {})[0]
    told = scored(s, d).select("*", score.alias("recall")).where("recall > 0")
    return told.select("id", F.round(F.col("recall") + F.col("confidence") + 3 * F.col("quality") - F.least(F.lit(40.0), F.col("misleading") * 20), 6).alias("rerank"))


@query("rk14_experience_rescoring", f"SELECT id, CAST({' + '.join(f'{_hits(c)} * {w}' for c, w in (('trigger_condition', 1.0), ('repair_action', 1.0), ('evidence', 0.8)))} AS DOUBLE) AS score FROM {EXPERIENCE_SQL}")
def _(s, d):
    score = index.weighted_fields("red widget economy", TERMS, [], {"trigger_condition": 1.0, "repair_action": 1.0, "evidence": 0.8}, {})[0]
    return views.experiences(s, d).select("id", score)


@query("rk15_file_rescoring", f"SELECT page_id, CAST({_hits('path', ['item', 'test', 'data'])} * 3.0 + CASE WHEN contains(path, 'Item3') THEN 12.0 ELSE 0 END + CASE WHEN contains(path, '/data/') THEN 20.0 WHEN contains(path, 'lib/') THEN 2.0 ELSE 0 END AS DOUBLE) AS score FROM {PATHS_SQL}")
def _(s, d):
    base = index.weighted_fields("item", ["item", "test", "data"], [], {"path": 3.0}, {})[0]
    told = views.paths(s, d).select("page_id", "path", base)
    extra = F.when(F.col("path").contains("Item3"), 12.0).otherwise(0.0) + F.when(F.array_contains(T.path_terms(F.col("path")), "data"), 20.0).when(F.col("path").contains("lib/"), 2.0).otherwise(0.0)
    return told.select("page_id", (F.col("score") + extra).alias("score"))


@query("rk16_symbol_rescoring", f"SELECT p_partkey, CAST({_hits('p_name')} * 3.0 + {_hits('p_type')} * 2.5 + CASE WHEN lower(p_name) = 'red widget' THEN 12.0 ELSE 0 END + CASE WHEN contains(lower(p_name), 'widget') THEN 1.5 ELSE 0 END - CASE WHEN p_size > 45 THEN 8.0 ELSE 0 END + CASE WHEN p_size > 0 THEN 2.0 ELSE 0 END AS DOUBLE) AS score FROM part")
def _(s, d):
    base = index.weighted_fields("red widget", TERMS, [], {"p_name": 3.0, "p_type": 2.5}, {})[0]
    told = table(s, d, "part").select("p_partkey", "p_name", "p_size", base)
    extra = F.when(F.lower("p_name") == "red widget", 12.0).otherwise(0.0) + index.identifier_identity(F.col("p_name"), ["widget"]) - F.when(F.col("p_size") > 45, 8.0).otherwise(0.0) + F.when(F.col("p_size") > 0, 2.0).otherwise(0.0)
    return told.select("p_partkey", (F.col("score") + extra).alias("score"))


@query("rk17_log_rescoring", f"SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN (12.0 + 4.0) * CASE WHEN event_id % 4 = 0 THEN 0.9 ELSE 1.0 END WHEN event_type = 'signup' THEN 0.0 ELSE 0.0 END AS DOUBLE) AS score FROM {LINES_SQL}")
def _(s, d):
    told = logs.parsed(views.lines(s, d))
    exact = F.when(F.lower("message").contains("load profile failed"), 12.0).otherwise(0.0) + F.when(F.try_element_at("fields", F.lit("error_code")).isNotNull(), 4.0).otherwise(0.0)
    return told.select("event_id", F.when(F.lower("message").contains("load profile failed"), exact * F.when(F.col("event_id") % 4 == 0, 0.9).otherwise(1.0)).otherwise(0.0).alias("score"))


@query("rk23_event_match", f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'distinctive_literal' WHEN event_type = 'signup' THEN 'exact_template' ELSE 'none' END AS band FROM {LINES_SQL}")
def _(s, d):
    template = F.when(F.col("event_type") == "error", F.lit("Load profile failed code=${code}")).when(F.col("event_type") == "signup", "Session invalid").otherwise("${x}")
    said = T.canonical(F.lit("why: load profile failed code today, and session invalid?"))
    return views.lines(s, d).select("event_id", logs.match_band(template, said).alias("band"))


@query("rk24_log_anchors", f"SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 1.0 WHEN event_type = 'click' THEN 0.84 ELSE 0 END AS DOUBLE) AS confidence FROM {LINES_SQL} WHERE event_type IN ('error', 'click')")
def _(s, d):
    told = logs.parsed(views.lines(s, d)).where("event_type in ('error', 'click')")
    exact = F.lower("message").contains("load profile failed")
    coverage = F.when(F.lower("message").contains("navigate"), 0.8).otherwise(0.0)
    return told.select("event_id", F.when(exact, 1.0).when(coverage >= 0.8, F.round(0.74 + F.least(F.lit(0.16), 0.125 * coverage), 6)).otherwise(0.0).alias("confidence"))


@query("rk25_memory_gate", f"SELECT id, lane, score, row_number() OVER (PARTITION BY lane ORDER BY score DESC, id) <= 3 AND score >= 20 AS admitted FROM (SELECT id, experience_type AS lane, floor(least(100, CAST(4 * {_hits('trigger_condition')} + 10 * confidence + 15 * quality + CASE WHEN experience_type = 'correction_experience' THEN 6 ELSE 0 END - 20 * misleading AS DOUBLE)) * 1000.0 + 0.5 + 1e-7) / 1000.0 AS score FROM {_SCORED})")
def _(s, d):
    hits = index.weighted_fields("red widget economy", TERMS, [], {"trigger_condition": 4.0}, {})[0]
    told = scored(s, d).select("*", hits.alias("hits"))
    score = scoring.thousandths(F.least(F.lit(100.0), F.col("hits") + 10 * F.col("confidence") + 15 * F.col("quality") + F.when(F.col("experience_type") == "correction_experience", 6.0).otherwise(0.0) - 20 * F.col("misleading")))
    lanes = told.select("id", F.col("experience_type").alias("lane"), score.alias("score"))
    place = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("score"), "id"))
    return lanes.withColumn("place", place).select("id", "lane", "score", ((F.col("place") <= 3) & (F.col("score") >= 20)).alias("admitted"))


@query("rk29_evidence_chains", f"SELECT anchor, count(*) AS linked, CAST(CASE WHEN bool_or(source = 'log') AND bool_or(source = 'code') THEN 0.95 WHEN bool_or(source = 'log') THEN 0.7 ELSE 0.35 END AS DOUBLE) AS level FROM {ITEMS_SQL} WHERE anchor IS NOT NULL GROUP BY anchor HAVING count(*) >= 2")
def _(s, d):
    told = items(s, d).where("anchor is not null").groupBy("anchor").agg(F.count("*").alias("linked"), F.bool_or(F.col("source") == "log").alias("log"), F.bool_or(F.col("source") == "code").alias("code"))
    return told.where("linked >= 2").select("anchor", "linked", F.when(F.col("log") & F.col("code"), 0.95).when(F.col("log"), 0.7).otherwise(0.35).alias("level"))


@query("rk30_goal_plan", "SELECT 'diagnosis' AS goal, source, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('incident', 1.0), ('log', 1.0), ('code', 0.9), ('edge', 0.85), ('reflection', 0.65), ('semantic', 0.55), ('episode', 0.45)) v(source, weight)")
def _(s, d):
    asked = s.createDataFrame([("debug this error",)], "q string").select(T.goal(F.col("q")).alias("goal"))
    plan = s.createDataFrame([(g, source, w) for g, weights in scoring.GOAL_WEIGHTS.items() for source, w in weights.items()], "goal string, source string, weight double")
    return plan.join(F.broadcast(asked), "goal")


@query("rk34_source_ranges", "SELECT p_partkey, greatest(1, p_size - 2) AS first, least(p_size + 20, p_size + 2) AS last FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.greatest(F.lit(1), F.col("p_size") - 2).alias("first"), F.least(F.col("p_size") + 20, F.col("p_size") + 2).alias("last"))


@query("rk39_query_audit", f"SELECT source, id, count(*) OVER (PARTITION BY source) AS candidates FROM {ITEMS_SQL} QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) <= 3")
def _(s, d):
    told = items(s, d).select("source", "id", "score")
    counts = told.groupBy("source").agg(F.count("*").alias("candidates"))
    return tables.top_per_group(told, ["source"], [F.desc("score"), F.col("id")], 3).join(counts, "source").select("source", "id", "candidates")


# --- graph, governance, streams, evaluation --------------------------------------------------------------------------


@query("gr10_wrapped_logs", f"""WITH e AS (SELECT DISTINCT source, target FROM {CALLS_SQL}), k AS (SELECT p_partkey AS sink FROM part WHERE p_size = 7), w1 AS (SELECT source AS caller, target AS sink, 1 AS depth FROM e WHERE target IN (SELECT sink FROM k)),
    w2 AS (SELECT e.source, w1.sink, 2 FROM e JOIN w1 ON e.target = w1.caller WHERE e.source <> w1.sink), a AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2) SELECT caller, sink, min(depth) AS depth FROM a GROUP BY caller, sink QUALIFY row_number() OVER (PARTITION BY caller ORDER BY min(depth), sink) <= 32""")
def _(s, d):
    sinks = table(s, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("sink"))
    return logs.wrapped(views.calls(s, d), sinks, 2, 32)


@query("gr23_dispatch_candidates", "SELECT a.p_partkey AS caller, b.p_partkey AS candidate FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey WHERE a.p_size < 6 QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) <= 8")
def _(s, d):
    parts = table(s, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    first = tables.top_per_group(parts.select(F.col("p_partkey").alias("candidate"), "p_name", "p_type"), ["p_name", "p_type"], [F.col("candidate")], 9)  # of an owner and name, one more than are wanted
    met = parts.where("p_size < 6").select(F.col("p_partkey").alias("caller"), "p_name", "p_type").join(first, ["p_name", "p_type"]).where("caller <> candidate")
    return tables.top_per_group(met, ["caller"], [F.col("candidate")], 8).select("caller", "candidate")


@query("ag23_log_gaps", "SELECT logger, count(*) AS lines FROM (SELECT CASE event_id % 4 WHEN 3 THEN 'kernel' ELSE 'Store' END AS logger, event_type FROM events WHERE event_type <> 'error') GROUP BY logger HAVING count(*) >= 2")
def _(s, d):
    told = logs.parsed(views.lines(s, d)).where(F.try_element_at("fields", F.lit("reason")).isNull())
    return told.groupBy("logger").agg(F.count("*").alias("lines")).where("lines >= 2")


@query("ql20_plan_and_actual", "WITH p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 50 = 0), a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 50 = 1) SELECT count(*) FILTER (l_partkey IN (FROM a)) AS done, count(*) AS planned, (SELECT count(*) FROM a WHERE l_partkey NOT IN (FROM p)) AS unplanned FROM p")
def _(s, d):
    items_ = table(s, d, "lineitem")
    side = lambda k, name: items_.where(F.col("l_orderkey") % 50 == k).select("l_partkey").distinct().withColumn(name, F.lit(True))
    both = side(0, "p").join(side(1, "a"), "l_partkey", "full_outer")
    return both.agg(F.count_if(F.col("p") & F.col("a")).alias("done"), F.count("p").alias("planned"), F.count_if(F.col("a") & F.col("p").isNull()).alias("unplanned"))


@query("mu07_decided_conflicts", f"SELECT id, CASE WHEN before IS NOT NULL AND before <> proposed_value THEN 'superseded' ELSE status END AS status FROM (SELECT id, status, proposed_value, lead(proposed_value) OVER (PARTITION BY anchor_key, semantic_field ORDER BY id) AS before FROM {EXPERIENCE_SQL} WHERE proposed_value IS NOT NULL)")
def _(s, d):
    later = F.lead("proposed_value").over(Window.partitionBy("anchor_key", "semantic_field").orderBy("id"))
    told = views.experiences(s, d).where("proposed_value is not null").withColumn("later", later)
    return told.select("id", F.when(F.col("later").isNotNull() & (F.col("later") != F.col("proposed_value")), "superseded").otherwise(F.col("status")).alias("status"))


@query("st02_snapshot_diff", "SELECT change, count(*) AS files FROM (SELECT CASE WHEN p_partkey % 8 = 0 THEN 'removed' WHEN p_size % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM part) GROUP BY change")
def _(s, d):
    before = table(s, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"))
    after = table(s, d, "part").where("p_partkey % 8 <> 0").select("p_partkey", F.sha2(F.when(F.col("p_size") % 5 == 0, F.lit("new")).otherwise(F.col("p_name")), 256).alias("digest"))
    return tables.snapshot_changes(before, after, "p_partkey", "digest").groupBy("change").agg(F.count("*").alias("files"))


@query("st07_log_slices", f"""WITH h AS (SELECT user_id, event_id AS a, event_id + 40 AS b FROM {LINES_SQL} WHERE event_type = 'error'), m AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99) + 1 THEN 1 ELSE 0 END AS fresh FROM h)
    SELECT user_id, count(*) AS slices, max(n) AS longest FROM (SELECT user_id, max(b) - min(a) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) GROUP BY user_id, island) GROUP BY user_id""")
def _(s, d):
    hits = views.lines(s, d).where("event_type = 'error'").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 40).alias("b"))
    return tables.merged_intervals(hits, ["user_id"], "a", "b").groupBy("user_id").agg(F.count("*").alias("slices"), F.max(F.col("b") - F.col("a")).alias("longest"))


@query("ev09_paired_scores", "SELECT o_orderpriority, count(*) AS pairs, round(avg(m - b), 6) AS delta FROM (SELECT o_custkey, o_orderpriority, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS b, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS m FROM orders GROUP BY ALL) WHERE b IS NOT NULL AND m IS NOT NULL GROUP BY o_orderpriority")
def _(s, d):
    mean = lambda k: F.avg(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice")))
    pairs = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(mean(0).alias("b"), mean(1).alias("m")).where("b is not null and m is not null")
    return pairs.groupBy("o_orderpriority").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("m") - F.col("b")), 6).alias("delta"))


@query("ev16_cohort_report", "SELECT o_orderstatus, count(*) AS enrolled, count(*) FILTER (o_totalprice > 200000) AS completed, round(count(*) FILTER (o_totalprice > 200000) / count(*), 4) AS coverage FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_orderstatus")
def _(s, d):
    told = table(s, d, "orders").where("o_orderdate < timestamp_ntz'1997-01-01'").groupBy("o_orderstatus").agg(F.count("*").alias("enrolled"), F.count_if(F.col("o_totalprice") > 200000).alias("completed"))
    return told.withColumn("coverage", F.round(F.col("completed") / F.col("enrolled"), 4))


@query("sc14_note_sizes", "SELECT p_type AS kind, count(*) AS notes, CAST(sum(length(p_name) + length(p_brand) + 5) AS BIGINT) AS chars FROM part GROUP BY p_type")
def _(s, d):
    note = F.concat(F.lit("# "), "p_name", F.lit("\n\n"), "p_brand", F.lit("\n"))
    return table(s, d, "part").select(F.col("p_type").alias("kind"), F.length(note).alias("n")).groupBy("kind").agg(F.count("*").alias("notes"), F.sum("n").alias("chars"))



