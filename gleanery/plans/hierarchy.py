"""Dispatch over a class hierarchy made of suppliers (types), nations (interfaces), parts (methods) and items (calls)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dispatch
from ..sources.records import table
from .bound import query

#: Columns of entities and relations by the table that they are made of, as Spark and DuckDB read alike.
ENTITIES = {
    "supplier": {"key": "s_suppkey", "kind": "'class'", "name": "concat('T', s_suppkey)", "owner_name": "CAST(NULL AS VARCHAR(9))", "qualified_name": "concat('T', s_suppkey)", "file_path": "concat('src/T', s_suppkey % 40, '.ets')", "signature": "CAST(NULL AS VARCHAR(9))"},
    "nation": {"key": "10000000 + n_nationkey", "kind": "'interface'", "name": "concat('I', n_nationkey)", "owner_name": "CAST(NULL AS VARCHAR(9))", "qualified_name": "concat('I', n_nationkey)", "file_path": "'src/contracts.ets'", "signature": "CAST(NULL AS VARCHAR(9))"},
    "part": {
        "key": "20000000 + p_partkey", "kind": "'method'", "name": "concat('m', p_size % 4)", "owner_name": "concat('T', p_partkey % 60)", "qualified_name": "concat('T', p_partkey % 60, '.m', p_size % 4)", "file_path": "concat('src/T', p_partkey % 40, '.ets')",
        "signature": "CASE p_partkey % 5 WHEN 0 THEN '()' WHEN 1 THEN '(a: Map<[string, number]>)' WHEN 2 THEN '(f: (x, y) => z, s = \", (\") {' WHEN 3 THEN '(a /* , */, b)' ELSE 'broken(' END",
    },
}
RELATIONS = {
    "supplier WHERE s_suppkey > 0": {"source_key": "s_suppkey", "relation": "'extends'", "target_key": "CAST(NULL AS BIGINT)", "target_qualified": "concat('T', CAST((s_suppkey - 1 - (s_suppkey - 1) % 2) / 2 AS BIGINT))", "line": "1", "confidence": "CAST(1 AS DOUBLE)", "arity": "CAST(NULL AS INT)"},
    "supplier": {"source_key": "s_suppkey", "relation": "'implements'", "target_key": "CAST(NULL AS BIGINT)", "target_qualified": "concat('I', s_nationkey)", "line": "1", "confidence": "CAST(1 AS DOUBLE)", "arity": "CAST(NULL AS INT)"},
    "lineitem": {
        "source_key": "20000000 + l_partkey", "relation": "CASE l_linenumber % 5 WHEN 0 THEN 'imports' WHEN 1 THEN 'awaits' ELSE 'calls' END", "target_key": "CASE WHEN l_linenumber % 4 = 0 THEN 20000000 + l_suppkey END",
        "target_qualified": "concat(CASE WHEN l_linenumber % 2 = 0 THEN concat('T', l_suppkey % 30) ELSE concat('I', l_suppkey % 40) END, CASE WHEN l_linenumber < 7 THEN concat('.m', CAST(l_quantity AS INT) % 5) ELSE '' END)",
        "line": "CAST(l_quantity AS INT)", "confidence": "1 - l_discount * 9", "arity": "CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_quantity AS INT) % 3 END",
    },
}


def _sql(tables: dict[str, dict[str, str]]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {name}" for name, columns in tables.items()) + ")"


def _rows(s: SparkSession, d: str, tables: dict[str, dict[str, str]]) -> DataFrame:
    def one(name: str, columns: dict[str, str]) -> DataFrame:
        of, _, where = name.partition(" WHERE ")
        return table(s, d, of).where(where or "true").selectExpr(*(f"{v} AS {k}" for k, v in columns.items()))

    return reduce(DataFrame.union, (one(n, c) for n, c in tables.items()))


_ARITY = "CASE signature WHEN '()' THEN 0 WHEN '(a: Map<[string, number]>)' THEN 1 WHEN 'broken(' THEN NULL ELSE CASE WHEN signature IS NULL THEN NULL ELSE 2 END END"


@query("gr23_hierarchy_dispatch", rf"""WITH RECURSIVE e AS {_sql(ENTITIES)}, r AS {_sql(RELATIONS)},
    p AS (SELECT DISTINCT name AS child, target_qualified AS parent FROM r JOIN e ON key = source_key WHERE relation IN ('extends', 'implements')),
    up AS (SELECT child, parent AS ancestor, 1 AS depth FROM p UNION SELECT child, parent, depth + 1 FROM up JOIN p p2(c, parent) ON c = ancestor WHERE depth < 4),
    m AS (SELECT DISTINCT ancestor AS receiver, name AS method, unnest(CASE WHEN n IS NULL THEN [-1] ELSE [-1, n] END) AS arity, key, file_path, qualified_name, signature
        FROM (SELECT *, {_ARITY} AS n FROM e WHERE kind = 'method') JOIN up ON child = owner_name),
    k AS (SELECT DISTINCT source_key, relation, target_key FROM r WHERE relation IN ('calls', 'awaits') AND target_key IS NOT NULL),
    c AS (SELECT source_key, relation, regexp_extract(target_qualified, '^(.+)\.([^.]+)$', 1) AS receiver, regexp_extract(target_qualified, '^(.+)\.([^.]+)$', 2) AS method, coalesce(arity, -1) AS arity, min(line) AS line, max(confidence) AS confidence
        FROM r WHERE relation IN ('calls', 'awaits') AND contains(target_qualified, '.') GROUP BY ALL),
    met AS (SELECT c.*, m.key AS target_key, qualified_name, row_number() OVER w AS place, count(*) OVER (PARTITION BY source_key, relation, receiver, method, arity) AS n
        FROM c JOIN m USING (receiver, method, arity) WHERE NOT EXISTS (FROM k WHERE k.source_key = c.source_key AND k.relation = c.relation AND k.target_key = m.key)
        WINDOW w AS (PARTITION BY source_key, relation, receiver, method, arity ORDER BY file_path, qualified_name, signature, key)),
    f AS (SELECT source_key, relation, target_key, qualified_name AS target_qualified, line, least(confidence, 0.55) AS confidence, 'inferred' AS evidence_class, n > 8 AS truncated FROM met WHERE place <= 8
        QUALIFY row_number() OVER (PARTITION BY source_key, relation, target_key ORDER BY line, least(confidence, 0.55) DESC, n > 8) = 1),
    t AS (SELECT qualified_name AS receiver, min(key) AS target_key, bool_or(kind = 'interface') AS i FROM e WHERE kind <> 'method' GROUP BY ALL)
    SELECT * FROM f UNION ALL SELECT source_key, 'dispatches_via', target_key, c.receiver, min(line), 0.8, 'static', false FROM c LEFT JOIN t USING (receiver)
        WHERE coalesce(i, false) OR c.receiver IN (SELECT parent FROM p) GROUP BY source_key, target_key, c.receiver""")
def _(s, d):
    return dispatch.dispatch_candidates(_rows(s, d, ENTITIES), _rows(s, d, RELATIONS))


#: New text of some types' files, and the edges of the old hierarchy by key.
_TEXT = "concat('export class T', s_suppkey, ' extends T', s_suppkey % 7, CASE WHEN s_suppkey % 2 = 0 THEN concat(' implements I', s_suppkey % 25, ', I', s_suppkey % 4, '<X>') ELSE '' END, ' {{')".replace("{{", "{")


@query("gr24_dispatch_scope", f"""WITH e AS {_sql(ENTITIES)}, r AS {_sql(RELATIONS)}, c AS (SELECT s_suppkey, concat('src/T', s_suppkey % 40, '.ets') AS path FROM supplier WHERE s_nationkey = 3),
    h AS (SELECT r.source_key AS source, relation, t.key AS target FROM r JOIN e t ON t.qualified_name = r.target_qualified AND t.kind <> 'method' WHERE relation IN ('extends', 'implements')
        UNION SELECT source_key, 'dispatches_via', t.key FROM r JOIN e t ON t.qualified_name = split_part(r.target_qualified, '.', 1) AND t.kind <> 'method' WHERE relation = 'calls' AND r.line = 49 AND r.source_key % 7 = 0),
    old AS (SELECT target AS id FROM h WHERE relation <> 'dispatches_via' AND source IN (SELECT key FROM e WHERE file_path IN (SELECT path FROM c))),
    new AS (SELECT key FROM e WHERE name IN (SELECT unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['T' || s_suppkey % 7, 'I' || s_suppkey % 25, 'I' || s_suppkey % 4] ELSE ['T' || s_suppkey % 7] END) FROM c)),
    k AS (FROM old UNION FROM new), stale AS (FROM k UNION SELECT source FROM h WHERE target IN (FROM k))
    SELECT DISTINCT file_path AS path FROM e WHERE key IN (FROM stale)""")
def _(s, d):
    entities, relations = _rows(s, d, ENTITIES), _rows(s, d, RELATIONS)
    types = entities.where("kind <> 'method'").select(F.col("key").alias("target"), F.col("qualified_name").alias("name"))
    old = relations.where("relation in ('extends', 'implements')").select(F.col("source_key").alias("source"), "relation", F.col("target_qualified").alias("name"))
    via = relations.where("relation = 'calls' and line = 49 and source_key % 7 = 0").select(F.col("source_key").alias("source"), F.lit("dispatches_via").alias("relation"), F.split("target_qualified", "[.]")[0].alias("name"))
    edges = old.unionByName(via).join(types, "name").select("source", "relation", "target").distinct()
    changed = table(s, d, "supplier").where("s_nationkey = 3").selectExpr("concat('src/T', s_suppkey % 40, '.ets') AS path", f"{_TEXT} AS text")
    return dispatch.rebuild_scope(changed, entities.select(F.col("key").alias("id"), F.col("name").alias("symbol"), "file_path"), edges)
