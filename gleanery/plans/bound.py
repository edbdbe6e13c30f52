"""Operators bound to the driver's tables, each with the SQL of the same result. Names follow the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import feedback, graph, ranking, tables
from ..sources.records import table
from . import views
from .views import CALLS_SQL, FEEDBACK_SQL, OUTCOMES, PLACES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"there are two queries {name}")
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


# --- scans, filters --------------------------------------------------------------------------------------------------


@query("sc06_list_records", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 50")
def _(s, d):
    return table(s, d, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars").orderBy(F.desc("doc_id")).limit(50)


@query("sc07_lookup_by_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("pf01_active_records", "SELECT d.doc_id, coalesce(l.quality, 1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0 AND coalesce(l.quality, 1) = 1")
def _(s, d):
    found = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    return found.where("coalesce(toxic, 0) = 0 and coalesce(quality, 1) = 1").select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"))


@query("pf03_any_term_scan", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red%' OR p_type ILIKE '%econ%' OR p_brand ILIKE '%#7%'")
def _(s, d):
    return table(s, d, "part").where("p_name ilike '%red%' or p_type ilike '%econ%' or p_brand ilike '%#7%'").select("p_partkey", "p_name")


@query("pf08_matching_or_all", "SELECT o_orderkey, o_custkey FROM (SELECT *, max(CASE WHEN o_orderpriority LIKE '1-%' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS has FROM orders) WHERE o_orderpriority LIKE '1-%' OR has = 0")
def _(s, d):
    return tables.matching_or_all(table(s, d, "orders"), F.col("o_orderpriority").like("1-%"), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("pf16_value_present", "SELECT event_id, trim(props) NOT IN ('', '[]', '{}') AS present FROM events WHERE props IS NOT NULL")
def _(s, d):
    return table(s, d, "events").where("props is not null").select("event_id", T.present(F.col("props")).alias("present"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("jn01_inner", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def _(s, d):
    orders = table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return orders.join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey")


@query("jn02_left", "SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("jn05_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(s, d):
    urgent = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("jn06_dangling_edges", f"WITH e AS {CALLS_SQL}, n AS (SELECT p_partkey FROM part WHERE p_size < 40) SELECT side, count(*) AS edges FROM (SELECT 'source' AS side FROM e WHERE source NOT IN (SELECT * FROM n) UNION ALL SELECT 'target' FROM e WHERE target NOT IN (SELECT * FROM n)) GROUP BY side")
def _(s, d):
    nodes = table(s, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("node"))
    return graph.dangling(views.calls(s, d), nodes).groupBy("side").agg(F.count("*").alias("edges"))


@query("jn18_snapshot_changes", """
    WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0),
         b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def _(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    later = orders.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("v")))
    return tables.snapshot_changes(orders.where("k % 7 <> 0"), later, "k", "v")


@query("jn24_evidence_as_of", "SELECT o_orderkey, count(*) AS seen FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate <= o_orderdate GROUP BY o_orderkey")
def _(s, d):
    joined = table(s, d, "orders").join(table(s, d, "lineitem"), (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") <= F.col("o_orderdate")))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("seen"))


# --- aggregations ----------------------------------------------------------------------------------------------------


@query("ag02_edge_governance", f"SELECT relation, count(*) AS edges, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence < 0.5) AS low_confidence FROM {PLACES_SQL} GROUP BY relation")
def _(s, d):
    return graph.governance(views.places(s, d))


@query("ag03_connected_nodes", f"SELECT count(DISTINCT node) AS nodes FROM (SELECT source AS node FROM {CALLS_SQL} UNION SELECT target FROM {CALLS_SQL}) WHERE node IN (SELECT p_partkey FROM part)")
def _(s, d):
    ends = graph.degrees(views.calls(s, d)).select("node")
    return ends.join(table(s, d, "part").select(F.col("p_partkey").alias("node")), "node", "left_semi").agg(F.count("*").alias("nodes"))


@query("ag04_counts", "SELECT lang, source, count(*) AS documents FROM documents GROUP BY lang, source ORDER BY documents DESC, lang, source")
def _(s, d):
    return table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "lang", "source")


@query("ag05_dominant_relation", f"SELECT relation, edges, round(edges / total, 6) AS share FROM (SELECT relation, count(*) AS edges, sum(count(*)) OVER () AS total FROM {PLACES_SQL} GROUP BY relation) ORDER BY edges DESC, relation LIMIT 1")
def _(s, d):
    counts = views.places(s, d).groupBy("relation").agg(F.count("*").alias("edges"))
    total = counts.agg(F.sum("edges").alias("total"))
    return counts.join(F.broadcast(total)).select("relation", "edges", F.round(F.col("edges") / F.col("total"), 6).alias("share")).orderBy(F.desc("edges"), "relation").limit(1)


@query("ag07_having", "SELECT count(*) AS customers FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 5)")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").count().where("count >= 5").agg(F.count("*").alias("customers"))


@query("ag08_risk_rate", "SELECT source, n, rate, CASE WHEN n < 5 THEN 'unknown' WHEN rate >= 0.5 THEN 'high' WHEN rate >= 0.2 THEN 'moderate' ELSE 'low' END AS risk FROM (SELECT source, count(*) AS n, round(avg(1.0 - quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def _(s, d):
    rates = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(1.0 - F.col("quality")), 6).alias("rate"))
    return rates.withColumn("risk", F.when(F.col("n") < 5, "unknown").when(F.col("rate") >= 0.5, "high").when(F.col("rate") >= 0.2, "moderate").otherwise("low"))


@query("ag09_distinct_lists", "SELECT p_brand, max(p_size) AS largest, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def _(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("largest"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("ag11_unique_keys", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY p_name, p_brand HAVING count(*) = 1")
def _(s, d):
    return table(s, d, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).where("n = 1")


@query("ag14_stable_signals", f"SELECT record_id, outcome, count(*) AS events, count(DISTINCT coalesce(CAST(task_id AS VARCHAR), 'legacy-event:' || event_id)) AS tasks, bool_or(verified) OR count(DISTINCT coalesce(CAST(task_id AS VARCHAR), 'legacy-event:' || event_id)) >= 2 AS stable FROM {FEEDBACK_SQL} GROUP BY record_id, outcome")
def _(s, d):
    return feedback.stable_signals(views.feedback(s, d))


@query("ag17_usage_summary", "WITH c AS (SELECT record_id, outcome, count(*) AS c FROM " + FEEDBACK_SQL + " GROUP BY record_id, outcome) SELECT record_id, CAST(sum(c) AS BIGINT) AS events, " + ", ".join(f"CAST(coalesce(sum(c) FILTER (outcome = '{o}'), 0) AS BIGINT) AS {o}" for o in OUTCOMES.values()) + ", arg_max(outcome, (c, outcome)) AS dominant FROM c GROUP BY record_id")
def _(s, d):
    return feedback.usage_summary(views.feedback(s, d), list(OUTCOMES.values()))


@query("ag20_query_misses", f"SELECT lower(query) AS query, count(*) AS miss_count, max(event_id) AS last_event FROM {FEEDBACK_SQL} GROUP BY ALL")
def _(s, d):
    return feedback.misses(views.feedback(s, d))


@query("ag29_nearest_rank", """
    WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN value END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.95, 0) THEN value END) AS p95 FROM p GROUP BY event_type""")
def _(s, d):
    return tables.nearest_rank(table(s, d, "events"), ["event_type"], "value", [0.5, 0.95])


@query("ag33_mode", "SELECT c_mktsegment, arg_max(c_nationkey, (c, -c_nationkey)) AS nation, round(max(c) / sum(c), 6) AS consistency FROM (SELECT c_mktsegment, c_nationkey, count(*) AS c FROM customer GROUP BY ALL) GROUP BY c_mktsegment")
def _(s, d):
    counts = table(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("c"))
    return counts.groupBy("c_mktsegment").agg(F.max_by("c_nationkey", F.struct("c", -F.col("c_nationkey"))).alias("nation"), F.round(F.max("c") / F.sum("c"), 6).alias("consistency"))


@query("ag42_extension_points", f"SELECT node, count(*) AS degree FROM (SELECT source AS node FROM {CALLS_SQL} UNION ALL SELECT target FROM {CALLS_SQL}) GROUP BY node ORDER BY degree DESC, node LIMIT 12")
def _(s, d):
    return graph.degrees(views.calls(s, d)).orderBy(F.desc("degree"), "node").limit(12)


@query("ag43_several_owners", f"SELECT target, count(DISTINCT source) AS owners FROM {CALLS_SQL} GROUP BY target HAVING count(DISTINCT source) > 1")
def _(s, d):
    return graph.several_owners(views.calls(s, d))


# --- windows, tops, sets ---------------------------------------------------------------------------------------------


@query("wn01_place_in_group", "SELECT o_orderkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_custkey) AS of FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(s, d):
    by = Window.partitionBy("o_custkey")
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"), F.count("*").over(by).alias("of"))


@query("wn04_keep_last", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200")
def _(s, d):
    return tables.top_per_group(table(s, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 200).select("event_id", "event_type")


@query("wn05_forward_fill", "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS since FROM events")
def _(s, d):
    events = table(s, d, "events").withColumn("since", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return tables.filled_forward(events, ["user_id"], ["ts", "event_id"], "since").select("event_id", F.coalesce("since", F.lit(-1)).alias("since"))


@query("wn06_relative_score", "SELECT event_id, round(value / max(value) OVER (PARTITION BY event_type), 6) AS relevance FROM events")
def _(s, d):
    return ranking.normalised(table(s, d, "events"), "event_type", "value").select("event_id", "relevance")


@query("wn07_merged_intervals", """
    WITH i AS (SELECT user_id, event_id - 2 AS a, event_id + 2 AS b FROM events),
         m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
         g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, island""")
def _(s, d):
    lines = table(s, d, "events").select("user_id", (F.col("event_id") - 2).alias("a"), (F.col("event_id") + 2).alias("b"))
    return tables.merged_intervals(lines, ["user_id"], "a", "b")


@query("wn12_novelty", "WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS first FROM events GROUP BY user_id), r AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events) SELECT CAST(day AS VARCHAR) AS day, round(avg(CASE WHEN day = first THEN 1.0 ELSE 0.0 END), 6) AS novelty FROM r JOIN f USING (user_id) GROUP BY r.day")
def _(s, d):
    seen = table(s, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    first = F.min("day").over(Window.partitionBy("user_id"))
    return seen.withColumn("new", F.when(F.col("day") == first, 1.0).otherwise(0.0)).groupBy(F.col("day").cast("string").alias("day")).agg(F.round(F.avg("new"), 6).alias("novelty"))


@query("tk02_lane_limits", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= CASE event_type WHEN 'purchase' THEN 20 WHEN 'error' THEN 5 ELSE 10 END")
def _(s, d):
    limit = F.when(F.col("event_type") == "purchase", 20).when(F.col("event_type") == "error", 5).otherwise(10)
    by = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(s, d, "events").withColumn("place", F.row_number().over(by)).where("place <= 20").where(F.col("place") <= limit).select("event_id", "event_type")


@query("tk03_page", "SELECT event_id, event_type, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 30) ORDER BY value DESC, event_id LIMIT 15 OFFSET 10")
def _(s, d):
    return tables.page(table(s, d, "events").select("event_id", "event_type", "value"), "event_type", [F.desc("value"), F.col("event_id")], 20, 10, 15)


@query("so01_endpoints", f"SELECT source AS node FROM {PLACES_SQL} UNION SELECT target FROM {PLACES_SQL}")
def _(s, d):
    edges = views.places(s, d)
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


@query("so03_symmetric_difference", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    orders = table(s, d, "orders")
    f, p = (orders.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in "FP")
    return f.subtract(p).union(p.subtract(f))


@query("so05_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(s, d):
    orders = table(s, d, "orders")
    f, p = (orders.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in "FP")
    return f.intersect(p)


@query("so06_keep_best", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def _(s, d):
    return ranking.best_per(table(s, d, "events"), "user_id", "value", "event_id").select("user_id", "event_id", "value")


# --- text, retrieval -------------------------------------------------------------------------------------------------


@query("fn01_tokens", r"SELECT item_id, len(t) AS n_tokens, array_to_string(t[1:5], ' ') AS first FROM (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}_]+') AS t FROM benchmark)")
def _(s, d):
    t = T.tokens(F.col("text"))
    return table(s, d, "benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("first"))


@query("fn11_name_overlap", "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, ['red', 'widget', 'ring'] AS b FROM part)")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.round(T.jaccard(F.split("p_name", " "), F.array(*map(F.lit, ("red", "widget", "ring")))), 6).alias("overlap"))


@query("fn23_event_key", "SELECT event_id, substr(sha256(concat_ws(chr(10), event_type, CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR))), 1, 32) AS event_key FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", T.event_key(F.col("event_type"), F.col("user_id"), F.col("event_id")).alias("event_key"))


@query("fn26_score_band", "SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount * 8 >= 0.8 THEN 'excellent' WHEN 1 - l_discount * 8 >= 0.65 THEN 'good' WHEN 1 - l_discount * 8 >= 0.45 THEN 'fair' ELSE 'weak' END AS band FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.score_band(1 - F.col("l_discount") * 8).alias("band"))


@query("fn27_token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS estimate FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("estimate"))


@query("fn28_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '(^-+|-+$)', '', 'g') AS slug FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


BM25_TERMS = ("license", "licensed", "token", "rights", "pathetic")


@query("rk05_bm25", rf"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS t FROM documents),
         w AS (SELECT count(*) AS n, avg(len(t)) AS mean_len FROM t),
         h AS (SELECT doc_id, len(t) AS doc_len, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM t) WHERE term IN {BM25_TERMS} GROUP BY ALL),
         f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
    SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 6) AS score
    FROM h JOIN f USING (term), w GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100""")
def _(s, d):
    return ranking.bm25(table(s, d, "documents"), "doc_id", "text", list(BM25_TERMS), 100)


@query("rk09_rank_fusion", """
    WITH r AS (SELECT event_type AS channel, user_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY max(value) DESC, user_id) AS rank FROM events GROUP BY event_type, user_id)
    SELECT id, round(sum(CASE channel WHEN 'purchase' THEN 2.0 WHEN 'error' THEN 0.5 ELSE 1.0 END / (60 + rank)), 9) AS score, count(*) AS channels, min(rank) AS best_rank FROM r GROUP BY id
    ORDER BY score DESC, channels DESC, best_rank, id LIMIT 40""")
def _(s, d):
    best = table(s, d, "events").groupBy(F.col("event_type").alias("channel"), F.col("user_id").alias("id")).agg(F.max("value").alias("v"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("v"), "id")))
    return ranking.fuse(ranked, {"purchase": 2.0, "error": 0.5}, 40)


# --- graph, mutations ------------------------------------------------------------------------------------------------


@query("gr03_lineage", f"""
    WITH e AS (SELECT source, target, max(confidence) AS c FROM {CALLS_SQL} GROUP BY source, target), s AS (SELECT p_partkey AS node FROM part WHERE p_partkey < 3),
         one AS (SELECT e.source AS node, node AS seed, 0.72 + 0.2 * c AS score FROM e JOIN s ON e.target = s.node WHERE e.source <> s.node),
         two AS (SELECT e.source AS node, one.score * (0.72 + 0.2 * c) AS score FROM e JOIN one ON e.target = one.node WHERE e.source <> one.node AND e.source <> one.seed)
    SELECT node, round(max(score), 6) AS score FROM (SELECT node, score FROM one UNION ALL SELECT * FROM two) WHERE node NOT IN (SELECT node FROM s) GROUP BY node""")
def _(s, d):
    seeds = table(s, d, "part").where("p_partkey < 3").select(F.col("p_partkey").alias("node"), F.lit(1.0).alias("score"))
    return graph.lineage(views.calls(s, d), seeds, 2)


@query("gr11_transitive_callers", f"""
    WITH e AS (SELECT DISTINCT source, target FROM {CALLS_SQL}), a AS (SELECT DISTINCT source AS node FROM e WHERE target = 1), b AS (SELECT DISTINCT e.source AS node FROM e JOIN a ON e.target = a.node)
    SELECT node, min(depth) AS depth FROM (SELECT node, CAST(1 AS BIGINT) AS depth FROM a UNION ALL SELECT node, 2 FROM b) WHERE node <> 1 GROUP BY node""")
def _(s, d):
    return graph.callers(views.calls(s, d), table(s, d, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("node")), 2)


@query("gr28_strongest_edges", "SELECT l_orderkey AS source, l_partkey AS target, max(1 - l_discount) AS confidence FROM lineitem GROUP BY l_orderkey, l_partkey")
def _(s, d):
    items = table(s, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.lit("contains").alias("relation"), F.col("l_partkey").alias("target"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_shipdate").alias("recorded"), F.col("l_linenumber").alias("edge_id"))
    return graph.superseded(items).select("source", "target", "confidence")


@query("mu02_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'merged' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(s, d):
    customers = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    return tables.upsert(customers, customers.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("merged")), ["c_custkey"])


@query("mu03_insert_once", "SELECT min(event_id) AS event_id, user_id AS event_key FROM events GROUP BY user_id")
def _(s, d):
    events = table(s, d, "events").select("event_id", F.col("user_id").alias("event_key"))
    return tables.insert_new(events.limit(0), events, "event_key", [F.col("event_id")])


@query("mu03_insert_into_known", """
    WITH held AS (SELECT -user_id AS event_id, user_id AS event_key FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0))
    SELECT event_id, event_key FROM held UNION ALL SELECT min(event_id), user_id FROM events WHERE user_id NOT IN (SELECT event_key FROM held) GROUP BY user_id""")
def _(s, d):
    events = table(s, d, "events").select("event_id", F.col("user_id").alias("event_key"))
    held = events.where("event_key % 3 = 0").select((-F.col("event_key")).alias("event_id"), "event_key").distinct()
    return tables.insert_new(held, events, "event_key", [F.col("event_id")])
