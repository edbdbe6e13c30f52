"""Sources, predicates, mutations, streams and evaluation bound to the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, records, scoring, tables
from ..sources.records import table
from ..streaming import events as streams
from . import views
from .bound import query
from .views import EDGES_SQL, EXPERIENCE_SQL, FEEDBACK_SQL, LINES_SQL, PATHS_SQL

# --- sources ---------------------------------------------------------------------------------------------------------


@query("sc04_classified_files", f"SELECT CASE WHEN path LIKE '%.ts' THEN 'code' WHEN path LIKE '%.py' THEN 'code' ELSE 'data' END AS kind, count(*) AS files FROM {PATHS_SQL} GROUP BY 1")
def _(s, d):
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return views.paths(s, d).groupBy(F.when(suffix.isin(".ts", ".py", ".js", ".cpp"), "code").otherwise("data").alias("kind")).agg(F.count("*").alias("files"))


@query("sc05_ignored_folders", f"SELECT page_id FROM {PATHS_SQL} WHERE NOT contains(path, '/test/') AND NOT contains(path, '/data/')")
def _(s, d):
    return views.paths(s, d).where(~F.arrays_overlap(F.split("path", "/"), F.array(F.lit("test"), F.lit("data")))).select("page_id")


@query("sc08_by_paths", f"SELECT a.page_id, count(*) AS same FROM {PATHS_SQL} a JOIN {PATHS_SQL} b ON a.path = b.path WHERE b.page_id % 4 = 0 GROUP BY 1")
def _(s, d):
    wanted = views.paths(s, d).where("page_id % 4 = 0").groupBy("path").agg(F.count("*").alias("same"))
    return views.paths(s, d).join(wanted, "path").select("page_id", "same")


@query("sc11_git_log", "SELECT * FROM (VALUES ('a1', 'ann', 'first', 'x.py'), ('a1', 'ann', 'first', 'y/z.ts'), ('b2', 'bob', 'second', NULL)) v(sha, author, subject, path)")
def _(s, d):
    return records.commits(s.createDataFrame([("a1\x1fann\x1ffirst\nx.py\ny/z.ts\n\nb2\x1fbob\x1fsecond\n\n",)], "log string"))


@query("sc12_diff_hunks", "SELECT * FROM (VALUES ('a.py', 3, 4), ('a.py', 30, 1), ('b/c.ts', 1, 12)) v(path, start, length)")
def _(s, d):
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +3,4 @@ def f\n x\n@@ -9 +30 @@\n-y\n+z\ndiff --git a/b/c.ts b/b/c.ts\n--- /dev/null\n+++ b/b/c.ts\n@@ -0,0 +1,12 @@\n+q\n"
    return records.diff_hunks(s.createDataFrame([(diff,)], "diff string"))


@query("sc17_excerpts", f"""WITH h AS (SELECT user_id, event_id - 2 AS a, event_id + 2 AS b FROM {LINES_SQL} WHERE contains(line, 'failed')), m AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99) + 1 THEN 1 ELSE 0 END AS fresh FROM h)
    SELECT user_id, min(a) AS start, max(b) AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) GROUP BY user_id, island""")
def _(s, d):
    return records.excerpts(views.lines(s, d), "user_id", "event_id", F.col("line").contains("failed"), 2)


@query("sc20_manifest", "SELECT name, rows, digest FROM (SELECT 'events' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS digest FROM events WHERE ts <= TIMESTAMP '2024-01-15') UNION ALL SELECT 'orders', count(*), 0 FROM orders WHERE o_orderdate <= TIMESTAMP '2024-01-15'")
def _(s, d):
    told = records.manifest({"events": table(s, d, "events").select(F.col("event_id").alias("k"), F.col("ts").alias("t")), "orders": table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"))}, "k", "t", "2024-01-15")
    return told.select("name", "rows", F.when(F.col("digest") > 0, F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("digest"))


@query("ex04_links", r"""SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def _(s, d):
    return records.links(table(s, d, "pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@query("ex05_structural_edges", "SELECT relation, count(*) AS edges, CAST(any_value(c) AS DOUBLE) AS confidence FROM (SELECT 'contains' AS relation, 0.9 AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'emits', 0.8 FROM supplier) GROUP BY relation")
def _(s, d):
    inside = table(s, d, "orders").select("o_orderkey").join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select(F.lit("contains").alias("relation"), F.lit(0.9).alias("c"))
    return inside.union(table(s, d, "supplier").select(F.lit("emits"), F.lit(0.8))).groupBy("relation").agg(F.count("*").alias("edges"), F.max("c").alias("confidence"))


# --- predicates ------------------------------------------------------------------------------------------------------


@query("pf04_scale_guard", "SELECT p_partkey FROM part WHERE contains(p_name, 'widget') AND (SELECT max(p_partkey) FROM part) <= 50000")
def _(s, d):
    parts = table(s, d, "part").select("p_partkey", "p_name")
    allowed = F.broadcast(parts.agg((F.max("p_partkey") <= 50000).alias("allowed")).where("allowed"))
    return parts.where("contains(p_name, 'widget')").join(allowed).select("p_partkey")


@query("pf05_fresh_rows", "SELECT l_partkey, l_linenumber, CASE WHEN p_size % 9 = 0 THEN 'unverified' ELSE 'fresh' END AS status FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 9 = 0 OR p_size % 9 = l_linenumber % 9")
def _(s, d):
    known = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 9 > 0, F.col("p_size") % 9).alias("digest"))
    told = table(s, d, "lineitem").select("l_partkey", "l_linenumber").join(known, "l_partkey")
    status = F.when(F.col("digest").isNull(), "unverified").when(F.col("digest") == F.col("l_linenumber") % 9, "fresh")
    return told.withColumn("status", status).where("status is not null").select("l_partkey", "l_linenumber", "status")


@query("pf06_edges_without_stale", f"SELECT edge_id FROM {EDGES_SQL} WHERE source NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) AND target NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def _(s, d):
    stale = table(s, d, "part").where("p_size > 40").select("p_partkey")
    out = views.edges(s, d)
    for end in ("source", "target"):
        out = out.join(stale.withColumnRenamed("p_partkey", end), end, "left_anti")
    return out.select("edge_id")


@query("pf07_negative_clauses", "SELECT p_partkey FROM part WHERE contains(p_name, 'widget') AND NOT contains(p_name, 'red')")
def _(s, d):
    asked, excluded = T.positive_query("find the widget, not the red one")
    return table(s, d, "part").where(F.col("p_name").contains("widget") & ("widget" in asked)).where(~F.exists(F.array(*map(F.lit, excluded)), lambda t: F.array_contains(T.tokens(F.col("p_name")), t))).select("p_partkey")


@query("pf09_generated_or_all", f"SELECT page_id FROM (SELECT *, max(CASE WHEN path NOT LIKE '%.json' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id % 20) AS any_source FROM {PATHS_SQL}) WHERE path NOT LIKE '%.json' OR any_source = 0")
def _(s, d):
    files = views.paths(s, d).withColumn("g", F.col("page_id") % 20)
    return tables.matching_or_all(files, ~F.col("path").endswith(".json"), ["g"]).select("page_id")


@query("pf11_spec_match", "SELECT spec, count(*) AS found FROM (VALUES ('a', NULL, 'widget'), ('b', 7, NULL), ('c', NULL, 'econ')) v(spec, id, said) JOIN part ON (id IS NULL OR p_partkey = id) AND (said IS NULL OR contains(lower(p_name || ' ' || p_type), said)) GROUP BY spec")
def _(s, d):
    specs = s.createDataFrame([("a", None, "widget"), ("b", 7, None), ("c", None, "econ")], "spec string, id long, said string")
    fits = (F.col("id").isNull() | (F.col("p_partkey") == F.col("id"))) & (F.col("said").isNull() | F.lower(F.concat_ws(" ", "p_name", "p_type")).contains(F.col("said")))
    return table(s, d, "part").join(F.broadcast(specs), fits).groupBy("spec").agg(F.count("*").alias("found"))


@query("pf12_compact_records", f"SELECT id, CAST((scope IS NOT NULL) AS INTEGER) + (lesson IS NOT NULL)::INTEGER + (evidence IS NOT NULL)::INTEGER AS kept FROM {EXPERIENCE_SQL}")
def _(s, d):
    pairs = F.create_map(*(x for c in ("scope", "lesson", "evidence") for x in (F.lit(c), F.col(c))))
    return views.experiences(s, d).select("id", F.size(F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))).alias("kept"))


@query("pf13_redacted_excerpts", "SELECT conv_id, count(*) AS excerpts, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def _(s, d):
    held = table(s, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text", F.length("text").alias("chars"))).alias("x"))
    clean = held.withColumn("x", F.transform("x", lambda e: F.struct(e["turn"].alias("turn"), e["chars"].alias("chars"))))
    return clean.select("conv_id", F.size("x").cast("long").alias("excerpts"), F.aggregate("x", F.lit(0).cast("long"), lambda n, e: n + e["chars"]).alias("chars"))


@query("pf14_metric_whitelist", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'n_count' WHEN event_id % 3 = 1 THEN 't_ms' ELSE '' END AS kept FROM events")
def _(s, d):
    named = F.create_map(F.when(F.col("event_id") % 3 == 0, "n_count").when(F.col("event_id") % 3 == 1, "t_ms").otherwise("secret"), F.col("value"))
    return table(s, d, "events").select("event_id", F.array_join(F.map_keys(F.map_filter(named, lambda k, v: k.rlike("(_count|_ms|_tokens|_bytes)$"))), ",").alias("kept"))


@query("pf15_test_paths", f"SELECT page_id FROM {PATHS_SQL} WHERE lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%'")
def _(s, d):
    return views.paths(s, d).where("lower(path) like '%test%' or lower(path) like '%spec%'").select("page_id")


@query("pf17_rejected_records", f"SELECT id, concat_ws(',', CASE WHEN scope IS NULL THEN 'scope' END, CASE WHEN confidence > 0.855 THEN 'confidence' END) AS why FROM {EXPERIENCE_SQL} WHERE scope IS NULL OR confidence > 0.855")
def _(s, d):
    why = F.concat_ws(",", F.when(~scoring.has("scope"), "scope"), F.when(F.col("confidence") > 0.855, "confidence"))
    return views.experiences(s, d).select("id", why.alias("why")).where("why <> ''")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("jn14_group_changes", "SELECT p_name, p_type, count(*) AS changes FROM (SELECT p_name, p_type, p_brand, lag(p_brand) OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS before FROM part) WHERE before <> p_brand GROUP BY ALL")
def _(s, d):
    before = F.lag("p_brand").over(Window.partitionBy("p_name", "p_type").orderBy("p_partkey"))
    return table(s, d, "part").withColumn("before", before).where("before <> p_brand").groupBy("p_name", "p_type").agg(F.count("*").alias("changes"))


@query("jn15_shared_anchors", "SELECT a.o_orderkey AS anchor, b.l_orderkey AS linked, count(*) AS shared FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey FROM lineitem WHERE l_orderkey < 20) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b USING (l_partkey) WHERE a.o_orderkey <> b.l_orderkey GROUP BY ALL HAVING count(*) >= 2")
def _(s, d):
    items = table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    few = items.where("l_orderkey < 20").withColumnRenamed("l_orderkey", "anchor")
    return few.join(items.withColumnRenamed("l_orderkey", "linked"), "l_partkey").where("anchor <> linked").groupBy("anchor", "linked").agg(F.count("*").alias("shared")).where("shared >= 2")


@query("jn16_similar_changes", """WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), s AS (SELECT a.l_orderkey AS change, count(*) AS shared FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 7) GROUP BY 1)
    SELECT change, round(shared / (n + (SELECT n FROM c WHERE l_orderkey = 7) - shared), 6) AS similarity FROM s JOIN c ON c.l_orderkey = change""")
def _(s, d):
    items = table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    now = items.where("l_orderkey = 7").select("l_partkey")
    both = items.join(now, "l_partkey", "left_semi").groupBy(F.col("l_orderkey").alias("change")).agg(F.count("*").alias("both"))
    sizes = items.groupBy(F.col("l_orderkey").alias("change")).agg(F.count("*").alias("n"))
    score = F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6)
    return both.join(sizes, "change").join(F.broadcast(now.agg(F.count("*").alias("m")))).select("change", score.alias("similarity"))


@query("jn22_spans_covered", "SELECT c_custkey, count(*) AS spans, count(*) FILTER (hit) AS covered FROM (SELECT c_custkey, o_orderkey, bool_or(l_linenumber BETWEEN o_orderkey % 4 AND o_orderkey % 4 + 2) AS hit FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY c_custkey")
def _(s, d):
    spans = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = spans.join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")
    hit = joined.groupBy("c_custkey", "o_orderkey").agg(F.bool_or(F.col("l_linenumber").between(F.col("o_orderkey") % 4, F.col("o_orderkey") % 4 + 2)).alias("hit"))
    return hit.groupBy("c_custkey").agg(F.count("*").alias("spans"), F.count_if("hit").alias("covered"))


@query("jn25_call_order", """WITH p AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id) SELECT user_id, regexp_matches(path, 'v.*c.*p') AS in_order FROM p""")
def _(s, d):
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    told = table(s, d, "events").groupBy("user_id").agg(path.alias("path"))
    return told.select("user_id", T.in_order(F.col("path"), ["view", "click", "purchase"]).alias("in_order"))


# --- mutations and streams -------------------------------------------------------------------------------------------


@query("mu01_insert", f"SELECT id, 'fact' AS kind FROM {EXPERIENCE_SQL} UNION ALL SELECT conv_id, 'episode' FROM conversations WHERE turn = 0")
def _(s, d):
    episodes = table(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.lit("episode").alias("kind"))
    return views.experiences(s, d).select("id", F.lit("fact").alias("kind")).unionByName(episodes)


@query("mu05_merge_records", f"""WITH r AS (SELECT id, anchor_key, semantic_field, status, proposed_value FROM {EXPERIENCE_SQL} WHERE anchor_key IS NOT NULL), g AS (SELECT anchor_key, semantic_field, min(id) AS target, string_agg(proposed_value, '; ' ORDER BY id) AS body FROM r WHERE status = 'active' GROUP BY ALL HAVING count(*) > 1)
    SELECT r.anchor_key, r.semantic_field, id, CASE WHEN status = 'active' AND id = target THEN body ELSE proposed_value END AS proposed_value, CASE WHEN status = 'active' AND id <> target THEN 'merged' ELSE status END AS status, CASE WHEN status = 'active' AND id <> target THEN target END AS merged_into FROM r LEFT JOIN g USING (anchor_key, semantic_field)""")
def _(s, d):
    told = views.experiences(s, d).where("anchor_key is not null").select("id", "anchor_key", "semantic_field", "status", "proposed_value")
    return records.merged_records(told, ["anchor_key", "semantic_field"], "proposed_value")


@query("mu06_promoted_facts", f"SELECT id AS source_id, lesson AS fact FROM {EXPERIENCE_SQL} WHERE lesson IS NOT NULL AND verification_method IS NOT NULL AND status = 'active' AND id % 10 <> 0 UNION ALL SELECT id, 'held' FROM {EXPERIENCE_SQL} WHERE id % 10 = 0")
def _(s, d):
    told = views.experiences(s, d)
    held = told.where("id % 10 = 0").select(F.col("id").alias("source_id"), F.lit("held").alias("fact"))
    return records.promoted_records(told, held, F.col("lesson").isNotNull() & F.col("verification_method").isNotNull(), F.col("lesson"))[0]


@query("mu06_promoted_marks", f"SELECT CASE WHEN lesson IS NOT NULL AND verification_method IS NOT NULL AND status = 'active' THEN 'promoted' ELSE status END AS status, count(*) AS n FROM {EXPERIENCE_SQL} GROUP BY 1")
def _(s, d):
    told = views.experiences(s, d)
    none = told.limit(0).select(F.col("id").alias("source_id"), F.col("lesson").alias("fact"))
    return records.promoted_records(told, none, F.col("lesson").isNotNull() & F.col("verification_method").isNotNull(), F.col("lesson"))[1].groupBy("status").agg(F.count("*").alias("n"))


@query("mu08_use_counts", f"SELECT p_partkey, coalesce(n, 0) AS use_count, last AS last_used_at FROM part LEFT JOIN (SELECT record_id, count(*) AS n, max(ts) AS last FROM {FEEDBACK_SQL} GROUP BY 1) ON record_id = p_partkey")
def _(s, d):
    uses = views.feedback(s, d).select(F.col("record_id").alias("p_partkey"), "ts")
    return records.counted_use(table(s, d, "part").select("p_partkey"), uses, "p_partkey", "ts")


@query("mu09_rewritten_scope", "SELECT o_custkey, o_orderkey, 1 AS generation FROM orders WHERE o_custkey % 3 <> 0 OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus = 'F') UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus = 'F'")
def _(s, d):
    orders = table(s, d, "orders").select("o_custkey", "o_orderkey", F.lit(1).alias("generation"))
    fresh = table(s, d, "orders").where("o_custkey % 3 = 0 and o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return records.rewritten_scope(orders, fresh, "o_custkey", "generation")


@query("mu10_counters", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def _(s, d):
    from functools import reduce

    return reduce(lambda a, b: a.union(b), (table(s, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("orders", "lineitem", "events")))


_AFTER = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 90 <> 0"


@query("st01_changed_only", f"SELECT coalesce(a.o_orderkey, b.k) AS k, CASE WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM orders a LEFT JOIN ({_AFTER}) b ON a.o_orderkey = b.k WHERE b.k IS NULL OR b.v <> a.o_orderstatus")
def _(s, d):
    before = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    after = before.where("k % 90 <> 0").withColumn("v", F.when(F.col("k") % 50 == 0, "X").otherwise(F.col("v")))
    return records.changed_only(before, after, "k", "v", 1 << 40)


@query("st03_boundary_drift", "SELECT o_custkey, count(*) AS surface, count(*) FILTER (o_orderstatus = 'F') AS drifted FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("surface"), F.count_if(F.col("o_orderstatus") == "F").alias("drifted")).where("drifted > 0")


def _stream(s, d):
    graph.written(s.range(1))  # the shared folder is set
    folder = f"{s.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    found = streams.read_events(s, f"{d}/events.parque[t]", table(s, d, "events").schema)
    # The times have no zone; they count as UTC, whatever the session's zone is.
    return found.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")), folder


@query("st05_events_once", "SELECT event_type, count(*) AS events FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def _(s, d):
    events, folder = _stream(s, d)
    twice = events.select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("sent")).drop("sent")  # every event is sent twice
    return streams.run_once(streams.once_each(twice, "event_id", "ts", "60 days"), folder).groupBy("event_type").agg(F.count("*").alias("events"))


@query("st06_confirmed_signals", """WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT user_id % 3) AS tasks FROM events GROUP BY ALL), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
    SELECT event_type, count(*) AS windows, min(tasks) AS fewest FROM g, m WHERE tasks >= 2 AND day + INTERVAL 1 DAY <= mark GROUP BY event_type""")
def _(s, d):
    events, folder = _stream(s, d)
    found = streams.run_once(streams.confirmed(events.withColumn("task", F.col("user_id") % 3), ["event_type"], "task", "ts", "1 day", "1 hour"), folder)
    return found.groupBy("event_type").agg(F.count("*").alias("windows"), F.min("tasks").alias("fewest"))


# --- evaluation ------------------------------------------------------------------------------------------------------

_CASES = """(SELECT item_id, item_id % 4 AS rank, item_id % 3 = 0 AS blocked, item_id % 5 > 0 AS lane_ok FROM benchmark)"""


def _cases(s, d):
    return table(s, d, "benchmark").selectExpr("item_id", "item_id % 4 AS rank", "item_id % 3 = 0 AS blocked", "item_id % 5 > 0 AS lane_ok")


@query("ev01_golden_cases", f"SELECT count(*) AS cases, round(count(*) FILTER (rank > 0) / count(*), 6) AS hit_rate, round(count(*) FILTER (rank = 1) / count(*), 6) AS top1, count(*) FILTER (blocked) AS blocked, count(*) FILTER (rank > 0) / count(*) >= 0.7 AND count(*) FILTER (lane_ok) / count(*) >= 0.7 AS passed FROM {_CASES}")
def _(s, d):
    rate = lambda c: F.count_if(c) / F.count("*")
    return _cases(s, d).agg(F.count("*").alias("cases"), F.round(rate(F.col("rank") > 0), 6).alias("hit_rate"), F.round(rate(F.col("rank") == 1), 6).alias("top1"), F.count_if("blocked").alias("blocked"), ((rate(F.col("rank") > 0) >= 0.7) & (rate(F.col("lane_ok")) >= 0.7)).alias("passed"))


@query("ev03_evidence_cases", f"SELECT count(*) AS cases, round(count(*) FILTER (verification_method IS NOT NULL OR evidence IS NOT NULL OR source_case IS NOT NULL) / count(*), 6) AS with_evidence FROM {EXPERIENCE_SQL}")
def _(s, d):
    ok = scoring.some("verification_method", "evidence", "source_case")
    return views.experiences(s, d).agg(F.count("*").alias("cases"), F.round(F.count_if(ok) / F.count("*"), 6).alias("with_evidence"))


@query("ev05_graph_cases", f"SELECT relation, round(CAST(0.4 * avg(CASE WHEN confidence >= 0.95 THEN 1.0 ELSE 0 END) + 0.35 * avg(CASE WHEN evidence_class = 'exact' THEN 1.0 ELSE 0 END) + 0.25 * avg(CASE WHEN valid_to IS NULL THEN 1.0 ELSE 0 END) AS DOUBLE), 6) AS score FROM {EDGES_SQL} GROUP BY relation")
def _(s, d):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    score = 0.4 * share(F.col("confidence") >= 0.95) + 0.35 * share(F.col("evidence_class") == "exact") + 0.25 * share(F.col("valid_to").isNull())
    return views.edges(s, d).groupBy("relation").agg(F.round(score, 6).alias("score"))


@query("ev08_stage_profile", f"SELECT first_loss, count(*) AS cases FROM (SELECT CASE WHEN rank = 0 THEN 'recalled' WHEN NOT lane_ok THEN 'routed' WHEN blocked THEN 'kept' ELSE 'none' END AS first_loss FROM {_CASES}) GROUP BY 1")
def _(s, d):
    told = _cases(s, d).selectExpr("rank > 0 AS recalled", "lane_ok AS routed", "NOT blocked AS kept")
    return told.groupBy(scoring.first_failing(["recalled", "routed", "kept"]).alias("first_loss")).agg(F.count("*").alias("cases"))


@query("ev10_failure_layers", "SELECT layer, count(*) AS orders FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'retrieval' WHEN o_totalprice < 100000 THEN 'ranking' WHEN o_orderpriority LIKE '5%' THEN 'context' ELSE 'none' END AS layer FROM orders) GROUP BY layer")
def _(s, d):
    told = table(s, d, "orders").selectExpr("o_orderstatus <> 'P' AS retrieval", "o_totalprice >= 100000 AS ranking", "o_orderpriority NOT LIKE '5%' AS context")
    return told.groupBy(scoring.first_failing(["retrieval", "ranking", "context"]).alias("layer")).agg(F.count("*").alias("orders"))


@query("ev11_expected_relations", f"WITH x AS (SELECT DISTINCT source, target FROM {EDGES_SQL} WHERE relation = 'calls'), f AS (SELECT DISTINCT source, target FROM {EDGES_SQL} WHERE relation = 'imports') SELECT count(*) AS expected, count(*) FILTER ((source, target) IN (SELECT (source, target) FROM f)) AS found, round(count(*) FILTER ((source, target) IN (SELECT (source, target) FROM f)) / count(*), 6) AS recall FROM x")
def _(s, d):
    pairs = lambda r: views.edges(s, d).where(F.col("relation") == r).select("source", "target").distinct()
    told = pairs("calls").join(pairs("imports").withColumn("found", F.lit(True)), ["source", "target"], "left")
    return told.agg(F.count("*").alias("expected"), F.count("found").alias("found"), F.round(F.count("found") / F.count("*"), 6).alias("recall"))


@query("ev13_sealed_runs", "SELECT p_name, count(*) AS runs, count(DISTINCT p_brand) AS cases, count(*) > count(DISTINCT p_brand) AS repeated FROM part GROUP BY p_name")
def _(s, d):
    told = table(s, d, "part").withColumn("seal", F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256))
    return told.groupBy("p_name").agg(F.count("*").alias("runs"), F.countDistinct("seal").alias("cases")).withColumn("repeated", F.col("runs") > F.col("cases"))


@query("ag36_overhead_gates", """WITH v AS (SELECT o_custkey, sum(o_totalprice) FILTER (o_orderkey % 2 = 0) AS base, sum(o_totalprice) FILTER (o_orderkey % 2 = 1) AS memory FROM orders GROUP BY 1)
    SELECT o_custkey, round(memory / base - 1, 6) AS overhead, CASE WHEN memory / base - 1 <= 0.10 THEN 'pass' WHEN memory / base <= 2.0 THEN 'watch' ELSE 'fail' END AS gate FROM v WHERE base > 0 AND memory IS NOT NULL""")
def _(s, d):
    part = lambda k: F.sum(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice")))
    told = table(s, d, "orders").groupBy("o_custkey").agg(part(0).alias("base"), part(1).alias("memory")).where("base > 0 and memory is not null")
    ratio = F.col("memory") / F.col("base")
    return told.select("o_custkey", F.round(ratio - 1, 6).alias("overhead"), F.when(ratio - 1 <= 0.10, "pass").when(ratio <= 2.0, "watch").otherwise("fail").alias("gate"))


@query("ag44_gate_deltas", """WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, CAST(day AS VARCHAR) AS day, CASE WHEN n >= 8 THEN 'pass' WHEN n >= 3 THEN 'fail' ELSE 'skipped' END AS gate, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM g""")
def _(s, d):
    told = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    delta = F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    return told.select("event_type", F.col("day").cast("string").alias("day"), F.when(F.col("n") >= 8, "pass").when(F.col("n") >= 3, "fail").otherwise("skipped").alias("gate"), delta.alias("delta"))


@query("ag47_provider_health", "SELECT l_suppkey, count(*) AS runs, count(*) FILTER (l_returnflag = 'R') AS fallbacks, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS rate, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS families FROM lineitem GROUP BY l_suppkey")
def _(s, d):
    told = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("runs"), F.count_if(F.col("l_returnflag") == "R").alias("fallbacks"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("families"))
    return told.withColumn("rate", F.round(F.col("fallbacks") / F.col("runs"), 6))
