"""Graph operators over paths, neighbours, rules and impact, bound to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, imports, paths, tables
from ..sources.records import table
from . import views
from .bound import query
from .views import CALLS_SQL, EDGES_SQL, EXPERIENCE_SQL, PATHS_SQL

SEEDS_SQL = "(SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#2')"
ENTRIES_SQL = "(SELECT p_partkey AS node, 0.8 AS score FROM part WHERE p_size % 10 = 3)"
_EV = "CASE evidence_class WHEN 'exact' THEN 1.0 WHEN 'inferred' THEN 0.3 ELSE 0.25 END"
_SP = "CASE relation WHEN 'routes_to' THEN 0.85 WHEN 'calls' THEN 0.7 ELSE 0.5 END"


def _seeds(s, d):
    return table(s, d, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("node"))


def _entries(s, d):
    return table(s, d, "part").where("p_size % 10 = 3").select(F.col("p_partkey").alias("node"), F.lit(0.8).alias("score"))


@query("pf02_active_edges", f"SELECT relation, count(*) AS active FROM {EDGES_SQL} WHERE valid_to IS NULL GROUP BY relation")
def _(s, d):
    return views.edges(s, d).where("valid_to is null").groupBy("relation").agg(F.count("*").alias("active"))


def _reverse_sql(depth: int, per: int) -> str:
    base = f"""e AS (SELECT source, target, confidence, {_EV} AS ev, {_SP} AS sp FROM {EDGES_SQL} QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, edge_id) = 1),
        en AS {ENTRIES_SQL}, f0 AS (SELECT node AS seed, node AS loc, [CAST(node AS VARCHAR)] AS nodes, 0 AS hops, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS p FROM {SEEDS_SQL})"""
    out = []
    for k in range(depth + 1):
        if k == depth:
            out.append(f"SELECT f.*, false AS complete, true AS truncated, 0.2 AS entry FROM f{k} f WHERE loc NOT IN (SELECT node FROM en)")
        out.append(f"SELECT f.*, true, false, score FROM f{k} f JOIN en ON node = loc")
        if k < depth:
            base += f""", f{k + 1} AS (SELECT * FROM (SELECT seed, source AS loc, list_concat([CAST(source AS VARCHAR)], nodes) AS nodes, hops + 1 AS hops, c + confidence AS c, v + ev AS v, p + sp AS p FROM f{k} f JOIN e ON e.target = f.loc
                WHERE loc NOT IN (SELECT node FROM en) AND NOT list_contains(nodes, CAST(source AS VARCHAR))) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(c, 6) DESC, array_to_string(nodes, '>')) <= {per})"""
            out.append(f"SELECT f.*, false, false, 0.2 FROM f{k} f WHERE loc NOT IN (SELECT node FROM en) AND loc NOT IN (SELECT target FROM e)")
    head = out.pop(next(i for i, x in enumerate(out) if "AS complete" in x))
    return f"WITH {base}, w AS ({head} UNION ALL {' UNION ALL '.join(out)})"


_SCORE = """round(greatest(0, least(1, CAST(0.24 * CASE hops WHEN 0 THEN 1.0 ELSE v / hops END + 0.18 * CASE hops WHEN 0 THEN 0 ELSE c / hops END + 0.2 * entry + 0.12 / (1.0 + greatest(0, hops - 1) * 0.12)
    + 0.12 * CASE WHEN complete THEN 1.0 ELSE 0.35 END + 0.14 * CASE hops WHEN 0 THEN 0.5 ELSE p / hops END - CASE WHEN truncated THEN 0.2 ELSE 0 END AS DOUBLE))), 6)"""


@query("gr06_reverse_paths", f"{_reverse_sql(3, 5)} SELECT seed, array_to_string(nodes, '>') AS path, hops, complete, truncated FROM w")
def _(s, d):
    found = paths.reverse_paths(views.edges(s, d), _seeds(s, d), _entries(s, d), 3, 5)
    return found.select("seed", F.array_join("nodes", ">").alias("path"), "hops", "complete", "truncated")


@query("gr08_path_scores", f"{_reverse_sql(3, 5)} SELECT seed, array_to_string(nodes, '>') AS path, {_SCORE} AS score FROM w")
def _(s, d):
    found = paths.reverse_paths(views.edges(s, d), _seeds(s, d), _entries(s, d), 3, 5)
    return found.select("seed", F.array_join("nodes", ">").alias("path"), paths.path_score().alias("score"))


@query("so10_path_dedup", f"{_reverse_sql(2, 5)} SELECT array_to_string(nodes, '>') AS path, max({_SCORE}) AS score FROM w GROUP BY nodes")
def _(s, d):
    found = paths.reverse_paths(views.edges(s, d), _seeds(s, d), _entries(s, d), 2, 5).withColumn("score", paths.path_score())
    return found.groupBy(F.array_join("nodes", ">").alias("path")).agg(F.max("score").alias("score"))


@query("gr07_entry_points", f"SELECT page_id, CAST(CASE WHEN page_id % 6 = 0 THEN 0.5 WHEN page_id % 6 = 1 THEN 0.8 WHEN page_id % 6 = 2 THEN 0.75 WHEN page_id % 6 = 3 THEN 0.95 WHEN page_id % 6 = 4 THEN 1.0 END AS DOUBLE) AS score FROM {PATHS_SQL}")
def _(s, d):
    told = views.paths(s, d).selectExpr("page_id", "CASE page_id % 6 WHEN 0 THEN 'file' ELSE 'symbol' END AS kind", "CASE page_id % 6 WHEN 1 THEN 'Run' WHEN 2 THEN 'on_event' WHEN 3 THEN 'onClickBuy' WHEN 4 THEN 'onCreate' ELSE 'compute' END AS name", "CASE WHEN page_id % 6 IN (3, 4) THEN 'src/a.ets' ELSE path END AS path")
    return told.select("page_id", paths.entry_score(F.col("kind"), F.col("name"), F.col("path")).alias("score"))


@query("gr02_promoted_neighbours", f"""WITH s AS (SELECT p_partkey AS node, 20.0 + p_size AS score FROM part WHERE p_brand = 'Brand#2'), r AS (SELECT *, CASE relation WHEN 'imports' THEN 0.75 WHEN 'routes_to' THEN 0.95 WHEN 'renders_component' THEN 0.85 END AS ratio FROM {EDGES_SQL} WHERE relation <> 'calls'),
    b AS (SELECT source AS seed, target AS node, relation, ratio, confidence, 0.82 AS decay FROM r UNION ALL SELECT target, source, relation, ratio, confidence, CASE relation WHEN 'routes_to' THEN 0.9 ELSE 0.82 END FROM r),
    m AS (SELECT b.node, relation, round(CAST(least(score * ratio, score * decay + 5 * confidence) AS DOUBLE), 6) AS lifted FROM b JOIN s ON s.node = b.seed), t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY node ORDER BY lifted DESC, relation DESC) = 1)
    SELECT t.node, lifted AS score, relation FROM t LEFT JOIN s USING (node) WHERE lifted > coalesce(score, 0)""")
def _(s, d):
    scores = table(s, d, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("node"), (F.lit(20.0) + F.col("p_size")).alias("score"))
    return paths.promoted(views.edges(s, d), scores)


@query("gr01_related_edges", f"SELECT DISTINCT edge_id, relation FROM {EDGES_SQL} WHERE valid_to IS NULL AND (source IN {SEEDS_SQL} OR target IN {SEEDS_SQL})")
def _(s, d):
    active, seeds = views.edges(s, d).where("valid_to is null"), _seeds(s, d)
    ends = [active.join(seeds.withColumnRenamed("node", end), end, "left_semi").select("edge_id", "relation") for end in ("source", "target")]
    return ends[0].union(ends[1]).distinct()


@query("gr04_lineage_seeds", "SELECT p_partkey FROM (SELECT p_partkey, p_retailprice, p_name, max(p_retailprice) OVER () AS best FROM part) WHERE p_retailprice >= 0.7 * best OR contains(p_name, 'widget') ORDER BY p_retailprice DESC, p_partkey LIMIT 4")
def _(s, d):
    parts = table(s, d, "part").select("p_partkey", "p_retailprice", "p_name")
    best = F.broadcast(parts.agg(F.max("p_retailprice").alias("best")))
    return parts.join(best).where("p_retailprice >= 0.7 * best or contains(p_name, 'widget')").orderBy(F.desc("p_retailprice"), "p_partkey").limit(4).select("p_partkey")


@query("gr05_emitters", f"SELECT page_id, coalesce(p_partkey, -1) AS emitter, CASE WHEN p_partkey IS NULL THEN 'fallback' ELSE 'edge' END AS via FROM {PATHS_SQL} LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 25) ON p_partkey = page_id")
def _(s, d):
    known = table(s, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("page_id"), F.col("p_partkey").alias("emitter"))
    told = views.paths(s, d).select("page_id").join(known, "page_id", "left")
    return told.select("page_id", F.coalesce("emitter", F.lit(-1)).alias("emitter"), F.when(F.col("emitter").isNull(), "fallback").otherwise("edge").alias("via"))


@query("gr12_neighbourhood", f"""WITH e AS (SELECT source, target, max(confidence) AS c FROM (SELECT source, target, confidence FROM {EDGES_SQL} UNION ALL SELECT target, source, confidence FROM {EDGES_SQL}) GROUP BY source, target), n0 AS (SELECT 3 AS node),
    n1 AS (SELECT target AS node FROM e WHERE source IN (FROM n0) AND target NOT IN (FROM n0) GROUP BY target ORDER BY max(c) DESC, target LIMIT 30),
    n2 AS (SELECT target AS node FROM e WHERE source IN (FROM n1) AND target NOT IN (FROM n0) AND target NOT IN (FROM n1) GROUP BY target ORDER BY max(c) DESC, target LIMIT 30)
    SELECT node, 0 AS depth FROM n0 UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2""")
def _(s, d):
    return paths.neighbourhood(views.edges(s, d), s.createDataFrame([(3,)], "node long"), 2, 30)


@query("gr13_architecture_views", f"SELECT relation, CASE WHEN confidence >= 0.95 THEN 'strong' ELSE 'weak' END AS strength, count(*) AS edges, count(DISTINCT source) AS sources FROM {EDGES_SQL} GROUP BY ALL")
def _(s, d):
    return views.edges(s, d).groupBy("relation", F.when(F.col("confidence") >= 0.95, "strong").otherwise("weak").alias("strength")).agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"))


_LAYER = "CASE WHEN p_size < 15 THEN 'ui' WHEN p_size < 30 THEN 'service' ELSE 'data' END"
RULES = [
    {"id": "r1", "kind": "forbid_edge", "relation": "imports", "source_layer": "data", "target_layer": "ui"},
    {"id": "r2", "kind": "require_edge", "relation": "routes_to", "source_layer": "ui"},
    {"id": "r3", "kind": "single_owner", "relation": "renders_component"},
]


@query("gr19_architecture_rules", f"""WITH n AS (SELECT p_partkey AS node, {_LAYER} AS layer FROM part), e AS (SELECT e.*, a.layer AS sl, b.layer AS tl FROM {EDGES_SQL} e LEFT JOIN n a ON a.node = e.source LEFT JOIN n b ON b.node = e.target)
    SELECT DISTINCT 'r1' AS rule_id, 'forbid_edge' AS kind, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target FROM e WHERE relation = 'imports' AND sl = 'data' AND tl = 'ui'
    UNION ALL SELECT 'r2', 'require_edge', CAST(node AS VARCHAR), NULL FROM n WHERE layer = 'ui' AND node NOT IN (SELECT source FROM e WHERE relation = 'routes_to')
    UNION ALL SELECT 'r3', 'single_owner', NULL, CAST(target AS VARCHAR) FROM e WHERE relation = 'renders_component' GROUP BY target HAVING count(DISTINCT source) > 1""")
def _(s, d):
    nodes = table(s, d, "part").selectExpr("p_partkey AS node", f"{_LAYER} AS layer")
    return paths.rule_findings(RULES, views.edges(s, d), nodes)


@query("gr16_layers_crossed", f"""WITH n AS (SELECT p_partkey AS node, {_LAYER} AS layer FROM part) SELECT a.layer AS source_layer, b.layer AS target_layer, CASE WHEN b.layer = 'ui' AND a.layer <> 'ui' THEN 'error' WHEN a.layer = 'ui' AND b.layer = 'data' THEN 'warn' END AS severity, count(*) AS edges
    FROM {EDGES_SQL} e JOIN n a ON a.node = e.source JOIN n b ON b.node = e.target WHERE (b.layer = 'ui' AND a.layer <> 'ui') OR (a.layer = 'ui' AND b.layer = 'data') GROUP BY ALL""")
def _(s, d):
    nodes = table(s, d, "part").selectExpr("p_partkey AS node", f"{_LAYER} AS layer")
    end = lambda e: nodes.select(F.col("node").alias(e), F.col("layer").alias(f"{e}_layer"))
    told = views.edges(s, d).join(end("source"), "source").join(end("target"), "target")
    severity = F.when((F.col("target_layer") == "ui") & (F.col("source_layer") != "ui"), "error").when((F.col("source_layer") == "ui") & (F.col("target_layer") == "data"), "warn")
    return told.withColumn("severity", severity).where("severity is not null").groupBy("source_layer", "target_layer", "severity").agg(F.count("*").alias("edges"))


_CHANGED_SQL = "(SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#3')"


def _changed(s, d):
    return table(s, d, "part").where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("node"))


@query("gr20_impact_links", f"""WITH c AS {_CHANGED_SQL}, e AS (SELECT 'dependent' AS direction, * FROM {EDGES_SQL} WHERE target IN (FROM c) AND source NOT IN (FROM c) UNION ALL SELECT 'outgoing', * FROM {EDGES_SQL} WHERE source IN (FROM c)),
    u AS (SELECT *, {_EV} AS ev FROM e QUALIFY row_number() OVER (PARTITION BY direction, source, relation, target ORDER BY ev DESC, confidence DESC, edge_id) = 1)
    SELECT direction, source, relation, target, confidence FROM u QUALIFY row_number() OVER (PARTITION BY direction ORDER BY ev DESC, confidence DESC, edge_id) <= 300""")
def _(s, d):
    return paths.impact_links(views.edges(s, d), _changed(s, d))


@query("so08_unique_links", f"SELECT source, relation, target, confidence FROM {EDGES_SQL} QUALIFY row_number() OVER (PARTITION BY source, relation, target ORDER BY {_EV} DESC, confidence DESC, edge_id) = 1")
def _(s, d):
    rank = F.when(F.col("evidence_class") == "exact", 1.0).otherwise(0.3)
    return tables.top_per_group(views.edges(s, d), ["source", "relation", "target"], [F.desc(rank), F.desc("confidence"), F.col("edge_id")], 1).select("source", "relation", "target", "confidence")


@query("gr17_consumers_outside", f"SELECT e.target, count(DISTINCT e.source) AS consumers FROM {CALLS_SQL} e WHERE e.target IN {_CHANGED_SQL} AND e.source NOT IN {_CHANGED_SQL} GROUP BY e.target")
def _(s, d):
    changed = _changed(s, d)
    into = views.calls(s, d).join(changed.withColumnRenamed("node", "target"), "target", "left_semi").join(changed.withColumnRenamed("node", "source"), "source", "left_anti")
    return into.groupBy("target").agg(F.countDistinct("source").alias("consumers"))


@query("gr21_impact_score", f"""WITH k AS (SELECT e.target AS node, count(DISTINCT source) AS dependents, count(DISTINCT source) FILTER (source % 5 = 0) AS unlearned, count(*) FILTER (confidence < 0.92) AS loud FROM {CALLS_SQL} e WHERE e.target IN {_CHANGED_SQL} GROUP BY 1)
    SELECT node, least(100, least(35, 8 + 12 * unlearned) + least(30, 10 * dependents) + least(15, 5 * loud)) AS score, CASE WHEN least(35, 8 + 12 * unlearned) + least(30, 10 * dependents) + least(15, 5 * loud) >= 70 THEN 'high' WHEN least(35, 8 + 12 * unlearned) + least(30, 10 * dependents) + least(15, 5 * loud) >= 30 THEN 'medium' ELSE 'low' END AS band FROM k""")
def _(s, d):
    into = views.calls(s, d).join(_changed(s, d).withColumnRenamed("node", "target"), "target", "left_semi")
    told = into.groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("dependents"), F.countDistinct(F.when(F.col("source") % 5 == 0, F.col("source"))).alias("unlearned"), F.count_if(F.col("confidence") < 0.92).alias("loud"))
    score = F.least(F.lit(100), F.least(F.lit(35), 8 + 12 * F.col("unlearned")) + F.least(F.lit(30), 10 * F.col("dependents")) + F.least(F.lit(15), 5 * F.col("loud")))
    return told.select("node", score.alias("score")).withColumn("band", F.when(F.col("score") >= 70, "high").when(F.col("score") >= 30, "medium").otherwise("low"))


@query("gr22_test_history", """WITH c AS (SELECT l_orderkey AS change, list_distinct(list(l_partkey)) AS files FROM lineitem GROUP BY 1), now AS (SELECT files FROM c WHERE change = 5),
    s AS (SELECT change, len(list_intersect(c.files, now.files)) / len(list_distinct(list_concat(c.files, now.files))) AS similarity FROM c, now WHERE len(list_intersect(c.files, now.files)) > 0)
    SELECT l_suppkey AS test, round(CAST(sum(CASE WHEN l_returnflag = 'R' THEN 8.0 WHEN l_linestatus = 'F' THEN 2.0 ELSE 0 END * similarity - CASE WHEN l_discount >= 0.09 THEN 4.0 ELSE 0 END * similarity) AS DOUBLE), 6) AS score FROM s JOIN lineitem ON l_orderkey = change GROUP BY 1""")
def _(s, d):
    items = table(s, d, "lineitem")
    now = items.where("l_orderkey = 5").select("l_partkey").distinct()  # the files of one change
    sizes = items.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n"))
    shared = items.select("l_orderkey", "l_partkey").distinct().join(F.broadcast(now.limit(1000)), "l_partkey").groupBy("l_orderkey").agg(F.count("*").alias("both"))
    near = shared.join(sizes, "l_orderkey").join(F.broadcast(now.agg(F.count("*").alias("m")))).withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    score = F.when(F.col("l_returnflag") == "R", 8.0).when(F.col("l_linestatus") == "F", 2.0).otherwise(0.0) - F.when(F.col("l_discount") >= 0.09, 4.0).otherwise(0.0)
    return items.join(near.select("l_orderkey", "similarity"), "l_orderkey").groupBy(F.col("l_suppkey").alias("test")).agg(F.round(F.sum(score * F.col("similarity")), 6).alias("score"))


@query("gr26_repair_targets", f"""(SELECT 'weak' AS why, CAST(source AS VARCHAR) AS target, count(*) AS n FROM {EDGES_SQL} WHERE confidence < 0.92 GROUP BY source ORDER BY n DESC, CAST(source AS VARCHAR) LIMIT 15)
    UNION ALL (SELECT 'unverified', CAST(target AS VARCHAR), count(*) AS n FROM {EDGES_SQL} WHERE evidence_class = 'inferred' GROUP BY target ORDER BY n DESC, CAST(target AS VARCHAR) LIMIT 15)""")
def _(s, d):
    worst = lambda why, cond, end: views.edges(s, d).where(cond).groupBy(F.col(end).cast("string").alias("target")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(15).select(F.lit(why).alias("why"), "target", "n")
    return worst("weak", "confidence < 0.92", "source").union(worst("unverified", "evidence_class = 'inferred'", "target"))


@query("gr27_caller_owners", f"SELECT target, source AS owner, n FROM (SELECT target, source, count(*) AS n FROM {CALLS_SQL} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY target ORDER BY n DESC, source) <= 2")
def _(s, d):
    counts = views.calls(s, d).groupBy("target", F.col("source").alias("owner")).agg(F.count("*").alias("n"))
    return tables.top_per_group(counts, ["target"], [F.desc("n"), F.col("owner")], 2).select("target", "owner", "n")


@query("gr28_supersession", f"SELECT source, relation, target, confidence FROM {EDGES_SQL} WHERE valid_to IS NULL QUALIFY row_number() OVER (PARTITION BY source, relation, target ORDER BY confidence DESC, edge_id DESC) = 1")
def _(s, d):
    active = views.edges(s, d).where("valid_to is null").withColumn("recorded", F.col("edge_id"))
    return graph.superseded(active).select("source", "relation", "target", "confidence")


@query("ag41_layer_edges", f"WITH n AS (SELECT p_partkey AS node, {_LAYER} AS layer FROM part) SELECT layer, count(DISTINCT node) AS files, count(e.target) AS incoming FROM n LEFT JOIN {CALLS_SQL} e ON e.target = node GROUP BY layer")
def _(s, d):
    nodes = table(s, d, "part").selectExpr("p_partkey AS node", f"{_LAYER} AS layer")
    into = views.calls(s, d).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
    return nodes.join(into, "node", "left").groupBy("layer").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("incoming"))


@query("gr15_unordered_steps", f"""WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM {EDGES_SQL} WHERE source < 200 AND target < 200 AND source <> target), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON e.source = r.target)
    SELECT source AS node FROM r WHERE source = target UNION SELECT target FROM r WHERE source IN (SELECT source FROM r WHERE source = target)""")
def _(s, d):
    return graph.unordered(views.edges(s, d).where("source < 200 and target < 200").select("source", "target"))


@query("jn13_candidate_pairs", f"""WITH e AS (SELECT id, experience_type, list_distinct(regexp_extract_all(trigger_condition, '[a-z]+')) AS t, scope FROM {EXPERIENCE_SQL} WHERE trigger_condition IS NOT NULL AND scope IS NOT NULL AND id < 400)
    SELECT a.id AS older, b.id AS newer FROM e a JOIN e b ON a.id < b.id AND a.experience_type = b.experience_type AND a.scope = b.scope WHERE len(list_intersect(a.t, b.t)) = len(a.t) AND len(a.t) = len(b.t)""")
def _(s, d):
    told = views.experiences(s, d).where("trigger_condition is not null and scope is not null and id < 400").select("id", "experience_type", "scope", F.array_sort(F.array_distinct(T.tokens(F.col("trigger_condition")))).alias("t"))
    a, b = (told.select(F.col("id").alias(x), "experience_type", "scope", "t") for x in ("older", "newer"))
    return a.join(b, ["experience_type", "scope", "t"]).where("older < newer").select("older", "newer")


@query("jn19_rules_edges", f"SELECT r.id AS rule, count(*) AS edges FROM (VALUES ('a', 'imports', 0.9), ('b', NULL, 0.99), ('c', 'calls', NULL)) r(id, relation, least) JOIN {EDGES_SQL} e ON (r.relation IS NULL OR e.relation = r.relation) AND (r.least IS NULL OR e.confidence >= r.least) GROUP BY r.id")
def _(s, d):
    rules = s.createDataFrame([("a", "imports", 0.9), ("b", None, 0.99), ("c", "calls", None)], "rule string, wanted string, least double")
    fits = (F.col("wanted").isNull() | (F.col("relation") == F.col("wanted"))) & (F.col("least").isNull() | (F.col("confidence") >= F.col("least")))
    return views.edges(s, d).join(F.broadcast(rules), fits).groupBy("rule").agg(F.count("*").alias("edges"))


# --- references between files ----------------------------------------------------------------------------------------

_N = "CAST((page_id - page_id % 2) / 2 AS BIGINT)"
_NTH = f"CAST({_N} + {{}} AS VARCHAR(20))"
#: Files made of pages: sources and notes that refer to their neighbours, and the pages themselves.
FILE = {
    "path": f"""concat(CASE {_N} % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'src/lib' ELSE 'docs' END, '/', CASE WHEN {_N} % 10 = 7 THEN 'index' ELSE concat('f', {_N}) END,
        CASE page_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.py' WHEN 3 THEN '.md' WHEN 4 THEN '.html' ELSE '.ets' END)""",
    "text": f"""CASE WHEN page_id % 6 IN (0, 1, 5) THEN concat('import {{ a }} from "./f', {_NTH.format(3)}, '"; const b = require("../lib/f', {_NTH.format(4)}, '.js"); import c from "./lib"; import d from "react"; e = import("../../../up")',
            CASE WHEN page_id % 6 = 5 THEN concat('; router.pushUrl({{ url: "src/f', {_NTH.format(12)}, '" }})') ELSE '' END)
        WHEN page_id % 6 = 2 THEN concat('from .f', {_NTH.format(3)}, ' import f', {_NTH.format(6)}, ', g', chr(10), 'from ..src import f', {_NTH.format(2)}, chr(10), 'import src.f', {_NTH.format(9)}, chr(10), 'import os')
        WHEN page_id % 6 = 3 THEN concat('[a](f', {_NTH.format(3)}, '.md#x) [b](../src/f', {_NTH.format(2)}, '.ts) [c](http://example.org/) [d](#top) [e](../../out.md)') ELSE html END""",
}
FILES_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in FILE.items()) + " FROM pages)"


def source_files(s, d):
    return table(s, d, "pages").selectExpr(*(f"{v} AS {k}" for k, v in FILE.items()))


def _normal_sql(x: str) -> str:
    out = f"regexp_replace(regexp_replace(concat('/', {x}, '/'), '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    for _ in range(4):
        out = f"regexp_replace({out}, '/[^/]*[^/.][^/]*/\\.\\./', '/')"
    return out


def _tried_sql() -> str:
    """The list of paths to try, by kind."""
    stem, has = r"regexp_replace(base, '([^/])\.[^./]*$', '\1')", r"regexp_matches(base, '[^/]\.[^./]*$')"
    out = []
    for kind, endings in imports.SUFFIXES.items():
        own = ["base"] if kind == "link" else [] if kind == "python" else [f"CASE WHEN {has} THEN base END"]
        names = ["__init__"] if kind == "python" else [] if kind == "link" else ["__init__", "index"]
        tried = own + [f"CASE WHEN {stem} <> '' THEN concat({stem}, '{e}') END" for e in endings] + [f"concat(CASE WHEN base = '' THEN '' ELSE concat(base, '/') END, '{n}{e}')" for n in names for e in endings]
        out.append(f"WHEN '{kind}' THEN [{', '.join(tried)}]")
    return "CASE kind " + " ".join(out) + " END"


_LINKS_SQL = rf"""
    files AS {FILES_SQL}, typed AS (SELECT *, regexp_extract(path, '\.([a-z]+)$', 1) AS e, regexp_replace(path, '/[^/]*$', '') AS here FROM files),
    froms AS (SELECT path, here, unnest(regexp_extract_all(text, '(?m)^[ \t]*from[ \t]+(\.+[\w.]*)[ \t]+import[ \t]+([\w, \t*]+)', 1)) AS m, unnest(regexp_extract_all(text, '(?m)^[ \t]*from[ \t]+(\.+[\w.]*)[ \t]+import[ \t]+([\w, \t*]+)', 2)) AS names FROM typed WHERE e = 'py'),
    dotted AS (SELECT path, here, m AS spec FROM froms UNION ALL SELECT path, here, concat(m, '.', trim(n)) FROM (SELECT path, here, m, unnest(string_split(names, ',')) AS n FROM froms)),
    quoted AS (SELECT path, here, CASE e WHEN 'ets' THEN 'arkts' ELSE 'script' END AS kind, unnest(regexp_extract_all(text, '(?:from\s+|import\s*\(|require\s*\()\s*["'']([^"'']+)["'']', 1)) AS spec FROM typed WHERE e IN ('ts', 'js', 'ets')),
    routed AS (SELECT path, here, unnest(regexp_extract_all(text, 'pushUrl\(\s*\{{\s*url:\s*"([^"]+)"', 1)) AS spec FROM typed WHERE e = 'ets'),
    linked AS (SELECT path, here, unnest(CASE e WHEN 'md' THEN regexp_extract_all(text, '\[[^\]]+\]\(([^)]+)\)', 1) ELSE regexp_extract_all(text, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']*)["'']', 1) END) AS spec FROM typed WHERE e IN ('md', 'html')),
    refs AS (
        SELECT path, kind, spec, CASE WHEN starts_with(spec, '.') THEN concat(here, '/', spec) END AS base FROM quoted
        UNION SELECT path, 'route', spec, unnest([spec, concat(here, '/', spec)]) FROM routed
        UNION SELECT path, 'python', spec, concat(here, repeat('/..', length(regexp_extract(spec, '^\.+')) - 1), '/', replace(ltrim(spec, '.'), '.', '/')) FROM dotted
        UNION SELECT path, 'python', spec, replace(spec, '.', '/') FROM (SELECT path, unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:from|import)[ \t]+([A-Za-z_][\w.]*)', 1)) AS spec FROM typed WHERE e = 'py')
        UNION SELECT path, 'link', spec, CASE WHEN NOT regexp_matches(spec, '^[A-Za-z][A-Za-z0-9+.-]*:|^//') THEN
            CASE WHEN starts_with(spec, '/') THEN regexp_replace(spec, '[#?].*$', '') ELSE concat(here, '/', regexp_replace(spec, '[#?].*$', '')) END END FROM linked WHERE spec <> '' AND NOT starts_with(spec, '#')),
    inside AS (SELECT path, kind, spec, CASE WHEN NOT contains(n, '/../') THEN trim(n, '/') END AS base FROM (SELECT *, {_normal_sql("base")} AS n FROM refs WHERE base IS NOT NULL) UNION ALL SELECT path, kind, spec, NULL FROM refs WHERE base IS NULL),
    met AS (SELECT DISTINCT path, kind, spec, c AS target FROM (SELECT path, kind, spec, unnest({_tried_sql()}) AS c FROM inside WHERE base IS NOT NULL) WHERE c IN (SELECT path FROM files)),
    told AS (SELECT path, kind, spec, max(base IS NOT NULL) AS known FROM inside GROUP BY ALL),
    links AS (SELECT t.path, t.kind, t.spec, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' WHEN known THEN 'dangling' ELSE 'external' END AS status, target
        FROM told t LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY path, kind, spec) AS n FROM met) m ON m.path = t.path AND m.kind = t.kind AND m.spec = t.spec)"""


@query("ex04_resolved_links", f"WITH {_LINKS_SQL} SELECT * FROM links")
def _(s, d):
    return imports.resolved(source_files(s, d))


@query("sc03_entry_related", f"""WITH RECURSIVE {_LINKS_SQL},
    walk AS (SELECT DISTINCT path AS entry, path, 0 AS depth FROM files WHERE contains(path, '/index.') UNION SELECT entry, target, depth + 1 FROM walk JOIN links USING (path) WHERE target IS NOT NULL AND depth < 3)
    SELECT entry, path, min(depth) AS depth FROM walk GROUP BY entry, path""")
def _(s, d):
    files = source_files(s, d)
    return imports.reached(files.where("path like '%/index.%'"), imports.resolved(files), 3)
