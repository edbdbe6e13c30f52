"""Joins with fallbacks, reports, funnels and impact scores bound to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tables
from ..sources.records import table
from . import views
from .bound import query
from .views import CALLS_SQL, FEEDBACK_SQL, PLACES_SQL


@query("jn03_typed_endpoints", f"""
    WITH n AS (SELECT 'region:' || r_regionkey AS node, r_name AS name FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation)
    SELECT p.target, n.name AS source_name, p.relation FROM {PLACES_SQL} p JOIN n ON n.node = p.source""")
def _(s, d):
    node = lambda name, kind, key, label: table(s, d, name).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("source"), F.col(label).alias("source_name"))
    nodes = node("region", "region", "r_regionkey", "r_name").union(node("nation", "nation", "n_nationkey", "n_name"))
    return views.places(s, d).join(nodes, "source").select("target", "source_name", "relation")


@query("jn04_cross_owner_chain", """
    SELECT c_nationkey AS buyer, s_nationkey AS seller, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL""")
def _(s, d):
    items = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    buyers = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return items.join(buyers, "l_orderkey").where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("buyer"), F.col("s_nationkey").alias("seller")).agg(F.count("*").alias("n"))


@query("jn07_connected_semi", f"SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT source FROM {CALLS_SQL} WHERE confidence >= 0.97)")
def _(s, d):
    strong = views.calls(s, d).where("confidence >= 0.97").select(F.col("source").alias("p_partkey"))
    return table(s, d, "part").select("p_partkey", "p_name").join(strong, "p_partkey", "left_semi")


@query("jn08_fallback_join", """
    SELECT c_custkey, 'order' AS via, CAST(o_orderkey AS BIGINT) AS target FROM customer JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(s, d):
    customers, orders = table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    direct = customers.join(orders, "c_custkey").select("c_custkey", F.lit("order").alias("via"), F.col("o_orderkey").cast("long").alias("target"))
    return direct.unionByName(customers.join(orders, "c_custkey", "left_anti").select("c_custkey", F.lit("nation").alias("via"), F.col("c_nationkey").cast("long").alias("target")))


@query("jn10_link_counts", "SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS links FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(s, d):
    links = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus").join(links, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("links"))


@query("jn17_paired_variants", """
    SELECT user_id, a, b, round(b - a, 6) AS delta FROM (SELECT user_id, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id)
    WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(s, d):
    one = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    both = table(s, d, "events").groupBy("user_id").agg(one("click").alias("a"), one("view").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


@query("jn21_innermost_owner", """
    SELECT e.event_id, arg_min(o.event_id, (o.width, o.event_id)) AS owner FROM events e
    JOIN (SELECT user_id, event_id, ts, 1 + event_id % 30 AS width FROM events WHERE event_type = 'purchase') o
    ON o.user_id = e.user_id AND e.ts >= o.ts AND e.ts <= o.ts + o.width * INTERVAL 1 DAY GROUP BY e.event_id""")
def _(s, d):
    events = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts"))
    points = events.select("event_id", "user_id", micros.alias("a"), micros.alias("b"))
    owners = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("o_id"), micros.alias("x"), (1 + F.col("event_id") % 30).cast("int").alias("width"))
    owners = owners.withColumn("y", F.col("x") + F.col("width") * 86_400_000_000)
    held = tables.overlapping(points, owners, "user_id", 4 * 86_400_000_000)
    return held.groupBy("event_id").agg(F.min_by("o_id", F.struct("width", "o_id")).alias("owner"))


@query("ag10_trace_counts", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("ag18_feedback_observations", f"""
    SELECT CAST(sum(n) AS BIGINT) AS events, count(*) AS groups, count(*) FILTER (tasks >= 2) AS stable, count(*) FILTER (tasks < 2) AS pending
    FROM (SELECT record_id, outcome, query, count(*) AS n, count(DISTINCT task_id) AS tasks FROM {FEEDBACK_SQL} GROUP BY ALL)""")
def _(s, d):
    groups = views.feedback(s, d).groupBy("record_id", "outcome", "query").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("tasks"))
    return groups.agg(F.sum("n").alias("events"), F.count("*").alias("groups"), F.count_if(F.col("tasks") >= 2).alias("stable"), F.count_if(F.col("tasks") < 2).alias("pending"))


@query("ag27_tier_counts", "SELECT CASE WHEN value >= 75 THEN 'hot' WHEN value >= 45 THEN 'warm' WHEN value >= 15 THEN 'cold' ELSE 'archive' END AS tier, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    tier = F.when(F.col("value") >= 75, "hot").when(F.col("value") >= 45, "warm").when(F.col("value") >= 15, "cold").otherwise("archive")
    return table(s, d, "events").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("ag28_top_signals", "SELECT p_type AS signal, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, signal LIMIT 8")
def _(s, d):
    return table(s, d, "part").groupBy(F.col("p_type").alias("signal")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signal").limit(8)


@query("ag31_gate_ratios", f"""
    SELECT record_id, count(*) AS cases, CASE WHEN count(*) FILTER (outcome IN ('helpful', 'misleading')) = 0 THEN 1.0
    ELSE round(count(*) FILTER (outcome = 'helpful') / count(*) FILTER (outcome IN ('helpful', 'misleading')), 6) END AS ratio FROM {FEEDBACK_SQL} GROUP BY record_id""")
def _(s, d):
    good, judged = F.count_if(F.col("outcome") == "helpful"), F.count_if(F.col("outcome").isin("helpful", "misleading"))
    return views.feedback(s, d).groupBy("record_id").agg(F.count("*").alias("cases"), F.when(judged == 0, 1.0).otherwise(F.round(good / judged, 6)).alias("ratio"))


@query("ag38_segment_ratios", f"""
    SELECT task_id, count(*) AS n, round(count(*) FILTER (verified) / nullif(count(*) FILTER (outcome = 'helpful'), 0), 4) AS verified_ratio FROM {FEEDBACK_SQL} GROUP BY task_id""")
def _(s, d):
    helpful = F.count_if(F.col("outcome") == "helpful")
    return views.feedback(s, d).groupBy("task_id").agg(F.count("*").alias("n"), F.round(F.count_if("verified") / F.nullif(helpful, F.lit(0)), 4).alias("verified_ratio"))


@query("ag40_lane_actions", "SELECT event_type AS lane, count(*) AS n, max(value) AS most, round(avg(value), 6) AS mean, arg_max(event_id, (value, event_id)) AS top FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("lane")).agg(
        F.count("*").alias("n"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("event_id", F.struct("value", "event_id")).alias("top")
    )


@query("ag41_layer_summary", f"SELECT split_part(source, ':', 1) AS layer, count(DISTINCT source) AS nodes, count(*) AS edges FROM {PLACES_SQL} GROUP BY 1")
def _(s, d):
    return views.places(s, d).groupBy(F.split_part("source", F.lit(":"), F.lit(1)).alias("layer")).agg(F.countDistinct("source").alias("nodes"), F.count("*").alias("edges"))


@query("ag48_counterbalance", """
    SELECT user_id, abs(count(*) FILTER (event_id % 2 = 0) - count(*) FILTER (event_id % 2 = 1)) <= 1 AS balanced FROM events GROUP BY user_id""")
def _(s, d):
    side = lambda k: F.count_if(F.col("event_id") % 2 == k)
    return table(s, d, "events").groupBy("user_id").agg((F.abs(side(0) - side(1)) <= 1).alias("balanced"))


@query("ag49_stage_funnel", """
    SELECT CASE WHEN NOT (seen) THEN 'seen' WHEN NOT (used) THEN 'used' WHEN NOT (paid) THEN 'paid' ELSE 'none' END AS first_loss, count(*) AS n
    FROM (SELECT bool_or(event_type = 'view') AS seen, bool_or(event_type = 'click') AS used, bool_or(event_type = 'purchase') AS paid FROM events GROUP BY user_id) GROUP BY 1""")
def _(s, d):
    stages = {"seen": "view", "used": "click", "paid": "purchase"}
    passed = table(s, d, "events").groupBy("user_id").agg(*(F.bool_or(F.col("event_type") == kind).alias(stage) for stage, kind in stages.items()))
    first = F.coalesce(*(F.when(~F.col(stage), stage) for stage in stages), F.lit("none"))
    return passed.groupBy(first.alias("first_loss")).agg(F.count("*").alias("n"))


@query("wn10_matched_or_all", "SELECT event_id, user_id FROM (SELECT *, bool_or(value > 90) OVER (PARTITION BY user_id) AS has FROM events) WHERE value > 90 OR NOT has")
def _(s, d):
    has = F.bool_or(F.col("value") > 90).over(Window.partitionBy("user_id"))
    return table(s, d, "events").select("event_id", "user_id", "value", has.alias("has")).where("value > 90 OR NOT has").select("event_id", "user_id")


@query("wn11_neighbourhood", """
    SELECT event_id, user_id FROM (SELECT *, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM events) WHERE near""")
def _(s, d):
    near = F.bool_or(F.col("event_type") == "error").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2))
    return table(s, d, "events").select("event_id", "user_id", near.alias("near")).where("near").select("event_id", "user_id")


@query("wn13_counterbalanced_order", "SELECT event_id, CASE WHEN (event_id + user_id) % 2 = 0 THEN 'baseline' ELSE 'memory' END AS first FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.when((F.col("event_id") + F.col("user_id")) % 2 == 0, "baseline").otherwise("memory").alias("first"))


@query("rk40_sufficiency", "SELECT source, CASE WHEN count(*) FILTER (quality = 1) > 0 THEN 'reviewed' WHEN count(quality) > 0 THEN 'labelled' ELSE 'unknown' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def _(s, d):
    joined = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("source").agg(F.when(F.count_if(F.col("quality") == 1) > 0, "reviewed").when(F.count("quality") > 0, "labelled").otherwise("unknown").alias("status"))


@query("gr17_outside_consumers", f"SELECT DISTINCT source AS consumer FROM {CALLS_SQL} WHERE target % 100 = 1 AND source % 100 <> 1")
def _(s, d):
    return views.calls(s, d).where("target % 100 = 1 AND source % 100 <> 1").select(F.col("source").alias("consumer")).distinct()


@query("gr18_missing_anchor", f"SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT target FROM {CALLS_SQL} WHERE confidence > 0.985)")
def _(s, d):
    anchored = views.calls(s, d).where("confidence > 0.985").select(F.col("target").alias("p_partkey"))
    return table(s, d, "part").select("p_partkey").join(anchored, "p_partkey", "left_anti")


@query("gr21_impact_risk", f"""
    SELECT target, risk, CASE WHEN risk >= 70 THEN 'high' WHEN risk >= 30 THEN 'medium' ELSE 'low' END AS band FROM (
    SELECT target, least(35, 8 * count(*) FILTER (confidence < 0.93)) + least(30, 10 * count(DISTINCT source)) + 10 AS risk FROM {CALLS_SQL} GROUP BY target)""")
def _(s, d):
    weak, sources = F.count_if(F.col("confidence") < 0.93), F.countDistinct("source")
    scored = views.calls(s, d).groupBy("target").agg((F.least(F.lit(35), 8 * weak) + F.least(F.lit(30), 10 * sources) + 10).alias("risk"))
    return scored.withColumn("band", F.when(F.col("risk") >= 70, "high").when(F.col("risk") >= 30, "medium").otherwise("low"))


@query("ag32_recall_precision", f"""
    SELECT record_id, round(hit / nullif(expected, 0), 6) AS recall, coalesce(round(hit / nullif(found, 0), 6), 0.0) AS precision FROM (
    SELECT record_id, count(*) FILTER (verified AND outcome = 'helpful') AS hit, count(*) FILTER (verified) AS expected, count(*) FILTER (outcome = 'helpful') AS found FROM {FEEDBACK_SQL} GROUP BY record_id)""")
def _(s, d):
    helpful = F.col("outcome") == "helpful"
    sizes = views.feedback(s, d).groupBy("record_id").agg(F.count_if(F.col("verified") & helpful).alias("hit"), F.count_if("verified").alias("expected"), F.count_if(helpful).alias("found"))
    share = lambda of: F.round(F.col("hit") / F.nullif(F.col(of), F.lit(0)), 6)
    return sizes.select("record_id", share("expected").alias("recall"), F.coalesce(share("found"), F.lit(0.0)).alias("precision"))


@query("gr09_expected_near", f"SELECT source, target, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS r FROM (SELECT DISTINCT source, target, confidence FROM {CALLS_SQL})) WHERE r <= 4")
def _(s, d):
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "target"))
    return views.calls(s, d).select("source", "target", "confidence").distinct().withColumn("r", place).where("r <= 4").drop("r")


@query("gr16_layer_violations", f"SELECT source, target, CASE WHEN source % 10 = 0 THEN 'error' ELSE 'warning' END AS severity FROM {CALLS_SQL} WHERE source % 10 IN (0, 1) AND target % 10 = 9")
def _(s, d):
    crossing = views.calls(s, d).where("source % 10 IN (0, 1) AND target % 10 = 9")
    return crossing.select("source", "target", F.when(F.col("source") % 10 == 0, "error").otherwise("warning").alias("severity"))
