"""More operators bound to the driver's tables: evaluation, governance, diversification and range joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, tables
from ..sources.records import table
from . import views
from .bound import query
from .views import CALLS_SQL, FEEDBACK_SQL, PLACES_SQL


@query("ag01_table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def _(s, d):
    one = lambda name: table(s, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return one("orders").union(one("part")).union(one("events"))


@query("ag06_calibration_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


@query("ag12_missing_values", "SELECT count(*) FILTER (quality IS NULL) AS no_quality, count(*) FILTER (text IS NULL OR trim(text) = '') AS no_text FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    joined = table(s, d, "documents").select("doc_id", "text").join(table(s, d, "labels"), "doc_id", "left")
    return joined.agg(F.count_if(F.col("quality").isNull()).alias("no_quality"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("no_text"))


@query("ag13_coverage_scorecard", "SELECT source, score, CASE WHEN score >= 0.82 THEN 'ok' WHEN score >= 0.62 THEN 'watch' ELSE 'weak' END AS band FROM (SELECT source, round(0.4 * avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END) + 0.35 * avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END) + 0.25 * avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)")
def _(s, d):
    joined = table(s, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(s, d, "labels"), "doc_id", "left")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    score = 0.4 * share(F.col("n_chars") > 500) + 0.35 * share(F.col("quality").isNotNull()) + 0.25 * share(F.col("lang") == "en")
    scored = joined.groupBy("source").agg(F.round(score, 6).alias("score"))
    return scored.withColumn("band", F.when(F.col("score") >= 0.82, "ok").when(F.col("score") >= 0.62, "watch").otherwise("weak"))


@query("ag19_representatives", f"SELECT record_id, outcome, tasks, event_id FROM (SELECT record_id, outcome, count(DISTINCT task_id) AS tasks, max(event_id) AS event_id FROM {FEEDBACK_SQL} GROUP BY record_id, outcome)")
def _(s, d):
    return views.feedback(s, d).groupBy("record_id", "outcome").agg(F.countDistinct("task_id").alias("tasks"), F.max("event_id").alias("event_id"))


@query("ag26_quality_report", "SELECT count(*) FILTER (value < 45) AS low, count(*) FILTER (value >= 75) AS high, round(avg(value), 6) AS mean FROM events")
def _(s, d):
    return table(s, d, "events").agg(F.count_if(F.col("value") < 45).alias("low"), F.count_if(F.col("value") >= 75).alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query("ag30_latest_status", "SELECT user_id, count(*) AS n, max(value) AS slowest, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY user_id")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("slowest"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("ag34_paired_effect", """
    WITH p AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id)
    SELECT count(*) AS pairs, round(avg(b - a), 6) AS mean_delta, round(median(b - a), 6) AS median_delta, round(max(b / a), 6) AS worst_ratio FROM p WHERE a > 0 AND b IS NOT NULL""")
def _(s, d):
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    pairs = table(s, d, "events").groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b")).where("a > 0 and b is not null")
    delta = F.col("b") - F.col("a")
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.median(delta), 6).alias("median_delta"), F.round(F.max(F.col("b") / F.col("a")), 6).alias("worst_ratio"))


@query("ag37_macro_metric", "SELECT round(avg(m), 6) AS macro, count(*) AS strata FROM (SELECT source, avg(CAST(quality AS DOUBLE)) AS m FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def _(s, d):
    each = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("m"))
    return each.agg(F.round(F.avg("m"), 6).alias("macro"), F.count("*").alias("strata"))


@query("ag39_weighted_metric", "SELECT round(sum(n * m) / sum(n), 6) AS weighted FROM (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY p_brand)")
def _(s, d):
    each = table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("m"))
    return each.agg(F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 6).alias("weighted"))


@query("jn09_top_children", "SELECT o_orderkey, l_partkey, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1-%' QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_partkey) <= 2")
def _(s, d):
    orders = table(s, d, "orders").where("o_orderpriority like '1-%'").select("o_orderkey")
    joined = orders.join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", "l_extendedprice")
    return tables.top_per_group(joined, ["o_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey")], 2)


@query("jn11_priority_resolution", """
    WITH a AS (SELECT p_name, p_brand, min(p_partkey) AS k FROM part WHERE p_size < 25 GROUP BY ALL HAVING count(*) = 1), b AS (SELECT p_name, p_type, min(p_partkey) AS k FROM part GROUP BY ALL HAVING count(*) = 1)
    SELECT p_partkey, coalesce(a.k, b.k, -1) AS target FROM part p LEFT JOIN a USING (p_name, p_brand) LEFT JOIN b USING (p_name, p_type)""")
def _(s, d):
    part = table(s, d, "part")

    def unique(df, keys, name):
        return df.groupBy(*keys).agg(F.min("p_partkey").alias(name), F.count("*").alias("c")).where("c = 1").drop("c")

    first, second = unique(part.where("p_size < 25"), ["p_name", "p_brand"], "a"), unique(part, ["p_name", "p_type"], "b")
    return part.join(first, ["p_name", "p_brand"], "left").join(second, ["p_name", "p_type"], "left").select("p_partkey", F.coalesce("a", "b", F.lit(-1)).alias("target"))


@query("jn20_range_overlap", """
    WITH w AS (SELECT event_id, user_id, event_id AS a, event_id + 40 AS b FROM events WHERE event_type = 'error'), h AS (SELECT event_id AS h, user_id, event_id - 5 AS x, event_id + 5 AS y FROM events WHERE event_type = 'purchase')
    SELECT event_id, h FROM w JOIN h ON w.user_id = h.user_id AND a <= y AND b >= x""")
def _(s, d):
    events = table(s, d, "events").select("event_id", "user_id", "event_type")
    w = events.where("event_type = 'error'").select("event_id", "user_id", F.col("event_id").alias("a"), (F.col("event_id") + 40).alias("b"))
    h = events.where("event_type = 'purchase'").select(F.col("event_id").alias("h"), "user_id", (F.col("event_id") - 5).alias("x"), (F.col("event_id") + 5).alias("y"))
    return tables.overlapping(w, h, "user_id", 64).select("event_id", "h")


@query("jn23_prefix_terms", "SELECT t.term, count(*) AS names FROM (VALUES ('re'), ('wid'), ('small'), ('zzz')) t(term) JOIN (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) w ON starts_with(w.word, t.term) GROUP BY t.term")
def _(s, d):
    terms = s.createDataFrame([("re",), ("wid",), ("small",), ("zzz",)], "term string")  # terms of one query
    each = table(s, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    return each.join(F.broadcast(terms), F.col("word").startswith(F.col("term"))).groupBy("term").agg(F.count("*").alias("names"))


@query("wn02_stratified_sample", "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part), t AS (SELECT *, least(7, (r - 1) * 8 // c) AS stratum FROM r) SELECT p_partkey, p_brand, stratum FROM t QUALIFY row_number() OVER (PARTITION BY p_brand, stratum ORDER BY r) = 1")
def _(s, d):
    by = Window.partitionBy("p_brand")
    placed = table(s, d, "part").select("p_partkey", "p_brand", F.row_number().over(by.orderBy("p_partkey")).alias("r"), F.count("*").over(by).alias("c"))
    strata = placed.withColumn("stratum", F.least(F.lit(7), F.floor((F.col("r") - 1) * 8 / F.col("c"))).cast("long"))
    return tables.top_per_group(strata, ["p_brand", "stratum"], [F.col("r")], 1).select("p_partkey", "p_brand", "stratum")


@query("wn03_first_by_kind", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1")
def _(s, d):
    order = [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.col("o_orderkey")]
    return tables.top_per_group(table(s, d, "orders"), ["o_custkey"], order, 1).select("o_custkey", "o_orderkey")


@query("wn08_hash_chain", """
    WITH e AS (SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR)) AS digest, row_number() OVER w AS place, lag(sha256(CAST(event_id AS VARCHAR))) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, max(place) AS entries, bool_and((place = 1) = (before IS NULL)) AS contiguous FROM e GROUP BY user_id""")
def _(s, d):
    order = Window.partitionBy("user_id").orderBy("event_id")
    chained = table(s, d, "events").select("user_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("digest"))
    chained = chained.withColumn("place", F.row_number().over(order).cast("long")).withColumn("before", F.lag("digest").over(order))
    return chained.groupBy("user_id").agg(F.max("place").alias("entries"), F.bool_and((F.col("place") == 1) == F.col("before").isNull()).alias("contiguous"))


@query("wn08_chain_breaks", """
    WITH e AS (SELECT user_id, event_id, row_number() OVER w AS n, lag(sha256(CAST(event_id AS VARCHAR))) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
         s AS (SELECT user_id, n, sha256(CAST(event_id AS VARCHAR)) AS digest, CASE WHEN event_id % 97 = 0 THEN 'altered' ELSE p END AS previous FROM e WHERE event_id % 101 <> 0),
         b AS (SELECT *, lag(digest) OVER w AS d, coalesce(lag(n) OVER w, 0) AS m FROM s WINDOW w AS (PARTITION BY user_id ORDER BY n))
    SELECT user_id, count(*) AS entries, count(*) FILTER (previous IS DISTINCT FROM d) AS broken, count(*) FILTER (n <> m + 1) AS gaps FROM b GROUP BY user_id""")
def _(s, d):
    # Planted: an altered previous digest in one of 97 entries, and one of 101 missing.
    order = Window.partitionBy("user_id").orderBy("event_id")
    chained = table(s, d, "events").select("user_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("digest"))
    chained = chained.withColumn("n", F.row_number().over(order).cast("long")).withColumn("previous", F.lag("digest").over(order))
    stored = chained.where("event_id % 101 <> 0").withColumn("previous", F.when(F.col("event_id") % 97 == 0, "altered").otherwise(F.col("previous")))
    return tables.chain_breaks(stored, "user_id", "n", "digest", "previous")


@query("wn09_delta_to_previous", "SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id), value), 6) AS delta FROM events")
def _(s, d):
    before = F.lag("value").over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    return table(s, d, "events").select("event_id", F.round(F.col("value") - F.coalesce(before, "value"), 6).alias("delta"))


@query("tk04_relation_priority", f"SELECT source, target, relation, confidence FROM {PLACES_SQL} ORDER BY CASE relation WHEN 'emits' THEN 0 WHEN 'contains' THEN 1 ELSE 2 END, confidence DESC, source, target LIMIT 40")
def _(s, d):
    rank = F.when(F.col("relation") == "emits", 0).when(F.col("relation") == "contains", 1).otherwise(2)
    return views.places(s, d).select("source", "target", "relation", "confidence").orderBy(rank, F.desc("confidence"), "source", "target").limit(40)


@query("tk05_cap_with_refill", "SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) ORDER BY CASE WHEN r <= 2 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey LIMIT 60")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    # A group gives 60 rows at most, so the windows limit themselves within tasks.
    placed = table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice").withColumn("r", r).where("r <= 60")
    return placed.orderBy((F.col("r") > 2).cast("int"), F.desc("p_retailprice"), "p_partkey").limit(60).select("p_partkey", "p_brand")


@query("tk09_relation_diverse", f"WITH e AS (SELECT source, relation, target, confidence FROM {PLACES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY source, relation ORDER BY confidence DESC, target) AS n FROM e) SELECT source, target FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, confidence DESC, target) <= 2")
def _(s, d):
    n = F.row_number().over(Window.partitionBy("source", "relation").orderBy(F.desc("confidence"), "target"))
    first = views.places(s, d).withColumn("n", n).where("n <= 2")
    return tables.top_per_group(first, ["source"], [(F.col("n") > 1).cast("int"), F.desc("confidence"), F.col("target")], 2).select("source", "target")


@query("tk16_token_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM conversations) WHERE spent <= 300")
def _(s, d):
    spent = F.sum(T.token_estimate(F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(s, d, "conversations").withColumn("spent", spent).where("spent <= 300").select("conv_id", "turn")


@query("so02_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("name")).union(table(s, d, "region").select("r_name"))


@query("so04_unseen", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(s, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("fn18_volatile_values", "SELECT event_id, regexp_replace(lower(event_type || ' id=' || (1000000 + event_id) || ' v=' || CAST(user_id AS VARCHAR)), '0x[0-9a-f]+|[0-9]{6,}', '<value>', 'g') AS line FROM events")
def _(s, d):
    line = F.concat(F.col("event_type"), F.lit(" id="), (1000000 + F.col("event_id")).cast("string"), F.lit(" v="), F.col("user_id").cast("string"))
    return table(s, d, "events").select("event_id", F.regexp_replace(F.lower(line), "0x[0-9a-f]+|[0-9]{6,}", "<value>").alias("line"))


@query("fn22_freshness", "SELECT o_orderkey, CAST(CASE WHEN age <= 30 THEN 1.0 WHEN age <= 180 THEN 0.75 WHEN age <= 365 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS freshness FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS age FROM orders)")
def _(s, d):
    age = F.datediff(F.to_date(F.lit("2001-01-01")), F.to_date("o_orderdate"))
    return table(s, d, "orders").select("o_orderkey", F.when(age <= 30, 1.0).when(age <= 180, 0.75).when(age <= 365, 0.5).otherwise(0.25).alias("freshness"))


@query("fn35_normal_query", r"SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS query FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", T.normal_query(F.col("text")).alias("query"))


@query("rk12_weighted_fields", "SELECT p_partkey, CAST(3.0 * (CAST(contains(lower(p_name), 'red') AS INT) + CAST(contains(lower(p_name), 'ring') AS INT) + CAST(contains(lower(p_name), 'econ') AS INT)) + 1.5 * (CAST(contains(lower(p_type), 'red') AS INT) + CAST(contains(lower(p_type), 'ring') AS INT) + CAST(contains(lower(p_type), 'econ') AS INT)) AS DOUBLE) AS score FROM part")
def _(s, d):
    wanted = F.array(*map(F.lit, ("red", "ring", "econ")))
    hits = lambda c: F.size(F.filter(wanted, lambda t: F.lower(F.col(c)).contains(t)))
    return table(s, d, "part").select("p_partkey", (3.0 * hits("p_name") + 1.5 * hits("p_type")).alias("score"))


@query("gr14_reachable", f"WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM {PLACES_SQL}), r(node) AS (SELECT 'region:0' UNION SELECT e.target FROM e JOIN r ON e.source = r.node) SELECT node FROM r WHERE node <> 'region:0'")
def _(s, d):
    return graph.reachable(views.places(s, d), s.createDataFrame([("region:0",)], "node string"))


@query("gr11_callers_of_brand", f"""
    WITH e AS (SELECT DISTINCT source, target FROM {CALLS_SQL}), s AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#1'),
         a AS (SELECT DISTINCT source AS node FROM e JOIN s ON target = node), b AS (SELECT DISTINCT source AS node FROM e JOIN a ON target = node), c AS (SELECT DISTINCT source AS node FROM e JOIN b ON target = node)
    SELECT node, min(depth) AS depth FROM (SELECT node, CAST(1 AS BIGINT) AS depth FROM a UNION ALL SELECT node, 2 FROM b UNION ALL SELECT node, 3 FROM c) WHERE node NOT IN (SELECT node FROM s) GROUP BY node""")
def _(s, d):
    return graph.callers(views.calls(s, d), table(s, d, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("node")), 3)


@query("gr25_graph_quality", f"WITH e AS {CALLS_SQL}, n AS (SELECT p_partkey AS node FROM part) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n WHERE node NOT IN (SELECT source FROM e UNION SELECT target FROM e)) AS orphans")
def _(s, d):
    edges, nodes = views.calls(s, d), table(s, d, "part").select(F.col("p_partkey").alias("node"))
    orphans = nodes.join(graph.degrees(edges), "node", "left_anti").agg(F.count("*").alias("orphans"))
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges"))).join(orphans)  # one row each


@query("ql07_tiers", "SELECT tier, count(*) AS customers FROM (SELECT CASE WHEN n >= 15 THEN 'hot' WHEN n >= 10 THEN 'warm' WHEN n >= 5 THEN 'cold' ELSE 'archive' END AS tier FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)) GROUP BY tier")
def _(s, d):
    n = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    tier = F.when(F.col("n") >= 15, "hot").when(F.col("n") >= 10, "warm").when(F.col("n") >= 5, "cold").otherwise("archive")
    return n.groupBy(tier.alias("tier")).agg(F.count("*").alias("customers"))


@query("mu04_status_transition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'stale' ELSE o_orderstatus END AS status FROM orders")
def _(s, d):
    old = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    return table(s, d, "orders").select("o_orderkey", F.when(old, "stale").otherwise(F.col("o_orderstatus")).alias("status"))


@query("ev07_reciprocal_rank", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events), m AS (SELECT user_id, coalesce(1.0 / min(r) FILTER (event_type = 'purchase'), 0.0) AS rr FROM r GROUP BY user_id) SELECT count(*) AS cases, round(avg(rr), 6) AS mrr FROM m")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    ranked = table(s, d, "events").select("user_id", "event_type", r.alias("r"))
    best = ranked.groupBy("user_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("event_type") == "purchase", F.col("r"))), F.lit(0.0)).alias("rr"))
    return best.agg(F.count("*").alias("cases"), F.round(F.avg("rr"), 6).alias("mrr"))
