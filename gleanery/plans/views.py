"""Views of the driver's tables in the shapes that the operators take, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.records import table

#: What each event type says about the record it concerns.
OUTCOMES = {"purchase": "helpful", "error": "misleading", "click": "used", "view": "ignored", "signup": "superseded"}

FEEDBACK_SQL = (
    "(SELECT event_id, event_id % 50 AS record_id, user_id AS task_id, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOMES.items())
    + " END AS outcome, event_type AS query, value > 90 AS verified, value, ts FROM events)"
)
CALLS_SQL = """(SELECT l_partkey AS source, nxt AS target, 'calls' AS relation, 1 - l_discount AS confidence FROM (
    SELECT l_partkey, l_discount, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt FROM lineitem) WHERE nxt IS NOT NULL)"""
PLACES_SQL = """(SELECT 'nation:' || n_nationkey AS target, 'region:' || n_regionkey AS source, 'contains' AS relation, CAST(1.0 AS DOUBLE) AS confidence FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'contains', CAST(0.9 AS DOUBLE) FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'emits', CAST(0.4 AS DOUBLE) FROM supplier)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    outcome = F.create_map(*(F.lit(x) for kv in OUTCOMES.items() for x in kv))[F.col("event_type")]
    return events.select("event_id", (F.col("event_id") % 50).alias("record_id"), F.col("user_id").alias("task_id"), outcome.alias("outcome"), F.col("event_type").alias("query"), (F.col("value") > 90).alias("verified"), "value", "ts")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item of an order calls the next one."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("target", F.lead("l_partkey").over(order))
    return items.where("target is not null").select(F.col("l_partkey").alias("source"), "target", F.lit("calls").alias("relation"), (1 - F.col("l_discount")).alias("confidence"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions contain nations, which contain customers and emit suppliers."""

    def edge(name: str, parent: str, key: str, child: str, of: str, relation: str, confidence: float) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{child}:"), F.col(key)).alias("target"), F.concat(F.lit(f"{of}:"), F.col(parent)).alias("source"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))

    return edge("nation", "n_regionkey", "n_nationkey", "nation", "region", "contains", 1.0).union(edge("customer", "c_nationkey", "c_custkey", "customer", "nation", "contains", 0.9)).union(edge("supplier", "s_nationkey", "s_suppkey", "supplier", "nation", "emits", 0.4))


#: Experience records made of parts, as expressions that Spark and DuckDB read alike.
EXPERIENCE = {
    "id": "p_partkey",
    "experience_type": "CASE p_size % 3 WHEN 0 THEN 'procedure_experience' WHEN 1 THEN 'correction_experience' ELSE 'semantic_patch_experience' END",
    "status": "CASE WHEN p_partkey % 23 = 0 THEN 'archived' WHEN p_partkey % 29 = 0 THEN 'stale' ELSE 'active' END",
    "is_stale": "p_partkey % 11 = 0",
    "scope": "CASE WHEN p_size % 7 > 0 THEN lower(p_type) END",
    "trigger_condition": "CASE WHEN p_size % 5 > 0 THEN concat('when a ', p_name, ' breaks') END",
    "repair_action": "CASE WHEN p_size % 4 > 0 THEN concat(CASE WHEN p_partkey % 2 = 0 THEN 'replace the ' ELSE 'glue and then paint a ' END, p_name, ' of ', p_brand) END",
    "verification_method": "CASE WHEN p_size % 4 = 1 THEN 'test' END",
    "source_case": "CASE WHEN p_size % 5 = 0 THEN concat('file:', p_name) WHEN p_size % 5 = 1 THEN 'manual: seen once' END",
    "evidence": "CASE WHEN p_partkey % 3 = 0 THEN p_type END",
    "anti_pattern": "CASE WHEN p_partkey % 4 = 0 THEN p_type END",
    "lesson": "CASE WHEN p_partkey % 2 = 0 THEN p_name END",
    "superseded_by": "CASE WHEN p_partkey % 17 = 0 THEN p_partkey + 1 END",
    "anchor_type": "CASE WHEN p_size % 3 = 2 THEN 'symbol' END",
    "anchor_key": "CASE WHEN p_size % 3 = 2 THEN p_name END",
    "semantic_field": "CASE WHEN p_size % 3 = 2 THEN p_type END",
    "proposed_value": "CASE WHEN p_size % 3 = 2 THEN p_brand END",
    "reuse_feedback": "CASE p_size % 6 WHEN 0 THEN 'It helped here' WHEN 1 THEN 'not tried' END",
    "last_outcome": "CASE WHEN p_size % 13 = 0 THEN 'misleading' END",
    "skill_candidate": "p_size % 9 = 0",
    "use_count": "p_size % 5",
    "misleading": "(p_size % 10) / 20.0",
    "confidence": "0.3 + (p_partkey % 60) / 100.0",
}
EXPERIENCE_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in EXPERIENCE.items()) + " FROM part)"


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*(f"{v} AS {k}" for k, v in EXPERIENCE.items()))


_STAMP = "strftime(ts, '%m-%d %H:%M:%S')"
#: Lines of a runtime log made of events, in the forms that the parser knows and one that it does not.
_LINE = """concat(CASE event_id % 4 WHEN 0 THEN {stamp} WHEN 1 THEN concat(replace({stamp}, ' ', 'T'), ' pid=7 tid=9 app.main') WHEN 2 THEN concat({stamp}, ' com.app:ui') ELSE 'kernel' END,
    CASE event_id % 4 WHEN 3 THEN '' ELSE CASE event_type WHEN 'error' THEN ' E' WHEN 'click' THEN ' I' WHEN 'view' THEN ' DEBUG' WHEN 'purchase' THEN ' WARN' ELSE ' INFO' END END,
    CASE event_id % 4 WHEN 3 THEN ': ' ELSE ' Store: ' END,
    CASE event_type WHEN 'error' THEN concat('Load profile failed code=E', user_id, ' reason=timeout request_id=', event_id)
        WHEN 'click' THEN concat('Navigate route=pages/', user_id % 7, ' session_id=', user_id)
        WHEN 'view' THEN concat('GET /api/items/', user_id) WHEN 'purchase' THEN concat('[Order] result=success duration_ms=', event_id % 90) ELSE 'Session invalid' END)"""
LINES_SQL = "(SELECT event_id, user_id, event_type, ts, " + _LINE.format(stamp=_STAMP) + " AS line FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "ts", _LINE.format(stamp="date_format(ts, 'MM-dd HH:mm:ss')") + " AS line")


#: Edges with their evidence and time of validity, made of items: an item leads to the next of its order.
EDGE = {
    "edge_id": "l_orderkey * 10 + l_linenumber",
    "source": "l_partkey",
    "relation": "CASE l_suppkey % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'routes_to' ELSE 'renders_component' END",
    "confidence": "1 - l_discount",
    "evidence_class": "CASE l_linestatus WHEN 'F' THEN 'exact' ELSE 'inferred' END",
    "valid_to": "CASE WHEN l_returnflag = 'R' THEN l_shipdate END",
}
_NEXT = "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
EDGES_SQL = "(SELECT * FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in EDGE.items()) + f", {_NEXT} AS target FROM lineitem) WHERE target IS NOT NULL)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{v} AS {k}" for k, v in EDGE.items()), f"{_NEXT} AS target").where("target is not null")


#: Paths of files, made of the addresses of pages.
PATHS_SQL = """(SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN 'src/pages/' WHEN 1 THEN 'src/test/' WHEN 2 THEN 'lib/data/' WHEN 3 THEN 'core/service/' ELSE 'config/' END,
    'Item', page_id % 7, CASE page_id % 5 WHEN 1 THEN 'Test' ELSE '' END, CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.json' END) AS path FROM pages)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {PATHS_SQL.replace('FROM pages', 'FROM {pages}')}", pages=table(spark, sf_dir, "pages").select("page_id"))
