"""Localisation of code for many requests at once: files are kinds and brands of parts, symbols are parts, requests name them."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import focus, index, localize
from ..operators.graph import sent, written
from ..sources.records import table
from . import views
from .bound import query
from .recall import sql_bm25, sql_tokens
from .views import EDGES_SQL

_NUMBER = "replace(p_brand, 'Brand#', '')"
#: Symbols made of parts, as expressions that Spark and DuckDB read alike.
SYMBOL = {
    "id": "p_partkey + 1",
    "file_path": f"concat('src/', lower(p_type), '/Brand', {_NUMBER}, CASE WHEN p_partkey % 9 = 0 THEN 'Test' ELSE '' END, '.ts')",
    "symbol": "replace(p_name, ' ', '_')",
    "symbol_type": "CASE p_partkey % 8 WHEN 0 THEN 'component' WHEN 1 THEN 'class' WHEN 2 THEN 'function' WHEN 3 THEN 'function' ELSE 'method' END",
    "start_line": "CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 1 + (p_partkey % 40) * 10 END AS INT)",
    "end_line": "CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE (p_partkey % 40) * 10 + p_size END AS INT)",
    "owner_name": f"concat('BrandStore', {_NUMBER})",
    "owner_kind": "CASE p_size % 6 WHEN 0 THEN 'service' WHEN 1 THEN 'store' WHEN 2 THEN 'manager' WHEN 3 THEN 'policy' WHEN 4 THEN 'component' END",
    "business_terms": "lower(p_type)",
    "business_summary": "CASE WHEN p_size % 3 > 0 THEN p_name END",
    "summary": "CASE WHEN p_size % 7 = 0 THEN concat('old ', p_name) END",
    "method_evidence": "p_brand",
    "string_evidence": "CASE WHEN p_size % 5 = 0 THEN 'state of the ring' END",
    "mechanism_line": "CASE WHEN p_size % 4 = 0 AND p_partkey % 13 > 0 THEN CAST((p_partkey % 40) * 10 + p_size % 9 AS INT) END",
    "mechanism_term": "split_part(p_name, ' ', 1)",
}
SYMBOLS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in SYMBOL.items()) + " FROM part)"
_KIND = "CASE n_nationkey % 5 WHEN 0 THEN 'service' WHEN 1 THEN 'store' WHEN 2 THEN 'manager' WHEN 3 THEN 'policy' ELSE 'gadget' END"
#: Requests made of nations, each after a part of its number.
REQUEST = {
    "request": "n_nationkey",
    "query": f"""concat(CASE WHEN n_nationkey % 7 = 6 THEN 'find both the ' ELSE 'find the ' END, {_KIND}, ' ', replace(p_name, ' ', '_'), ' of ', lower(p_type),
        CASE WHEN n_nationkey % 3 = 0 THEN concat(' in BrandStore', {_NUMBER}) ELSE '' END, CASE WHEN n_nationkey % 4 = 1 THEN ' test' ELSE '' END, CASE WHEN n_nationkey % 5 < 2 THEN ' state update' ELSE '' END)""",
    "plain": "n_nationkey % 6 <> 5",
}


def symbols(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").selectExpr(*(f"{v} AS {k}" for k, v in SYMBOL.items()))
    one = F.array(F.struct(F.col("mechanism_line").alias("line"), F.lit("state_write").alias("kind"), F.array("mechanism_term").alias("terms")))
    return rows.withColumn("mechanisms", F.when(F.col("mechanism_line").isNotNull(), one)).drop("mechanism_line", "mechanism_term")


def requests(s: SparkSession, d: str) -> DataFrame:
    named = table(s, d, "nation").join(table(s, d, "part"), F.col("n_nationkey") == F.col("p_partkey"))
    return named.selectExpr(*(f"{v} AS {k}" for k, v in REQUEST.items()))


def hits(asked: DataFrame, found: DataFrame, most: int = 200) -> DataFrame:
    """The symbols that share terms with a request: 8 for the name or a part of it, 3 for the owner, 2 for the kind."""
    told = lambda term, w: F.struct(F.lower(term).alias("term"), F.lit(w).alias("w"))
    part = lambda i: F.split("symbol", "_")[i]
    postings = found.select("id", "file_path", "symbol", F.size(F.coalesce("mechanisms", F.array())).alias("coverage"), F.explode(F.array(told(F.col("symbol"), 8.0), told(part(0), 8.0), told(part(1), 8.0), told(F.col("owner_name"), 3.0), told(F.col("business_terms"), 2.0))).alias("x"))
    terms = written(asked.select("request", F.explode(T.query_tokens(F.col("query"))).alias("term")))
    met = sent(terms).join(postings.select("*", "x.*").drop("x"), "term").groupBy("request", "id", "file_path", "coverage").agg(F.sum("w").alias("score"), F.max(F.col("term") == F.col("symbol")).alias("exact"))
    kind = F.when(F.col("id") % 10 == 3, "file").otherwise("symbol").alias("kind")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("*", kind)


_DONE: dict[tuple[str, str], localize.Localization] = {}
_LOCK = threading.Lock()


def located(s: SparkSession, d: str) -> tuple[DataFrame, localize.Localization]:
    """The stages for all requests, made once a session and folder."""
    asked = requests(s, d)
    key = (s.sparkContext.applicationId, d)
    with _LOCK:
        if key not in _DONE:
            found = symbols(s, d)
            edges = views.edges(s, d).where("valid_to is null").select((F.col("source") + 1).alias("source"), (F.col("target") + 1).alias("target"), "relation", "confidence")
            flows = edges.join(found.select(F.col("id").alias("source"), F.col("file_path").alias("source_path")).hint("merge"), "source").select("source_path", "target", "relation", "confidence")
            _DONE[key] = localize.Localization(asked, hits(asked, found), found, edges, flows)
    return asked, _DONE[key]


# --- SQL ------------------------------------------------------------------------------------------------------------

_MATCH = "CASE WHEN length(t) <= 3 THEN regexp_matches(lower(coalesce({0}, '')), concat('(^|[^a-z0-9])', t, '([^a-z0-9]|$)')) ELSE contains(lower(coalesce({0}, '')), t) END"
_LEXICAL = " + ".join(f"{w} * ({_MATCH.format(f)})::INT" for f, w in localize.FIELDS.items())


def _ranked(name: str, rows: str) -> str:
    return f"""
    {name}_0 AS (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY request, id ORDER BY graph_depth) = 1),
    {name}_1 AS (SELECT request, id, sum({_LEXICAL}) AS lexical FROM {name}_0 JOIN terms USING (request) GROUP BY ALL),
    {name}_2 AS (
        SELECT *, contains(lower(query), lower(symbol)) OR contains(lower(symbol), lower(query)) AS named,
            CASE WHEN mechanism_line IS NULL THEN 0 ELSE (SELECT count(DISTINCT m.t) FROM (SELECT t FROM terms WHERE terms.request = r.request UNION SELECT 'state_write' WHERE q.behaves) m
                WHERE m.t IN ('state_write', 'statewrite', lower(r.mechanism_term))) END AS hits,
            coalesce(owner_kind = target OR (target IS NULL AND owner_kind = kind), false) AS kind_match, coalesce(NOT several AND owner_kind = target, false) AS target_match,
            coalesce(contains(query, concat(owner_name, ' ')) OR ends_with(query, owner_name), false) AS owner_named,
            CASE WHEN NOT file_rank BETWEEN 1 AND 8 THEN 0 WHEN plain THEN 9 - file_rank ELSE round(12.0 * 11 / (10 + file_rank), 3) END AS prior
        FROM {name}_0 r JOIN {name}_1 USING (request, id) JOIN req q USING (request)),
    {name}_3 AS (
        SELECT *, lexical + CASE WHEN named THEN 12 ELSE 0 END + CASE WHEN plain THEN least(9.0, direct * 0.18) ELSE 0 END + prior + least(9, 3 * hits) + CASE WHEN kind_match THEN 6 ELSE 0 END
            + CASE WHEN graph_depth > 0 THEN 3 + 3 * graph_confidence ELSE 0 END + CASE WHEN start_line > 0 AND end_line > 0 THEN 0.5 ELSE 0 END AS whole FROM {name}_2),
    {name}_4 AS (
        SELECT *, round(whole, 3) AS score, round(CASE WHEN plain THEN whole ELSE whole - prior END, 3) AS evidence,
            CASE WHEN contains(file_path, 'Test.') THEN 'test' ELSE 'production' END AS role, lower(regexp_extract(file_path, '(Brand[0-9]+)', 1)) AS family,
            CASE WHEN ends_with(query, ' test') OR contains(query, ' test ') THEN 'test' ELSE 'production' END AS wanted FROM {name}_3),
    {name}_5 AS (SELECT *, count(DISTINCT role) OVER (PARTITION BY request, family) = 2 AS competing, max(score) OVER (PARTITION BY request, family) AS top FROM {name}_4),
    {name}_6 AS (SELECT *, competing AND role = wanted AS fits FROM {name}_5),
    {name}_7 AS (SELECT *, fits AND row_number() OVER (PARTITION BY request, family, fits ORDER BY score DESC, file_path, start_line, id) = 1 AS stands, competing AND NOT fits AS shadow FROM {name}_6),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY shadow, owner_named DESC, target_match DESC, CASE WHEN stands THEN top ELSE score END DESC, stands DESC, graph_depth, file_path, start_line, id) AS place FROM {name}_7)"""


STAGES_SQL = f"""
    sym AS {SYMBOLS_SQL},
    req AS (
        SELECT *, contains(query, 'state update') AS behaves, contains(query, ' both ') AS several, CASE WHEN n5 < 4 THEN word END AS kind, CASE WHEN n5 < 4 THEN word END AS target
        FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in REQUEST.items())}, {_KIND} AS word, n_nationkey % 5 AS n5 FROM nation JOIN part ON n_nationkey = p_partkey)),
    words AS (SELECT request, unnest(regexp_extract_all(query, '[A-Za-z0-9_]+')) AS word FROM req),
    terms AS (
        SELECT DISTINCT request, t FROM (
            SELECT request, lower(word) AS t FROM words UNION ALL SELECT request, unnest(string_split(word, '_')) FROM words WHERE contains(word, '_')
            UNION ALL SELECT request, unnest(['brand', lower(substr(word, 6))]) FROM words WHERE starts_with(word, 'BrandStore'))
        WHERE t NOT IN ('the', 'of', 'in')),
    post AS (
        SELECT id, lower(symbol) AS t, 8.0 AS w FROM sym UNION ALL SELECT id, lower(split_part(symbol, '_', 1)), 8.0 FROM sym UNION ALL SELECT id, lower(split_part(symbol, '_', 2)), 8.0 FROM sym
        UNION ALL SELECT id, lower(owner_name), 3.0 FROM sym UNION ALL SELECT id, business_terms, 2.0 FROM sym),
    hits AS (
        SELECT request, id, file_path, symbol_type, CASE WHEN id % 10 = 3 THEN 'file' ELSE 'symbol' END AS kind, (mechanism_line IS NOT NULL)::INT AS coverage, sum(w)::DOUBLE AS score, bool_or(t = symbol) AS exact,
            row_number() OVER (PARTITION BY request ORDER BY sum(w) DESC, id) AS rank
        FROM terms JOIN post USING (t) JOIN sym USING (id) GROUP BY request, id, file_path, symbol_type, mechanism_line, symbol QUALIFY rank <= 200),
    f0 AS (
        SELECT request, file_path, max(score) AS score, min(rank) AS first, max(coverage) AS coverage, bool_or(exact) AS exact,
            bool_or(kind = 'symbol' AND exact AND symbol_type IN ('class', 'component')) AS defined FROM hits GROUP BY ALL),
    f1 AS (
        SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, first, file_path) AS o,
            CASE WHEN defined THEN row_number() OVER (PARTITION BY request, defined ORDER BY score DESC, first, file_path) END AS a,
            CASE WHEN exact AND behaves THEN row_number() OVER (PARTITION BY request, exact ORDER BY score DESC, first, file_path) END AS b,
            CASE WHEN coverage > 0 AND behaves THEN row_number() OVER (PARTITION BY request, coverage > 0 ORDER BY coverage DESC, score DESC, first, file_path) END AS c
        FROM f0 JOIN req USING (request)),
    f2 AS (SELECT *, CASE WHEN a <= 3 THEN a WHEN b <= 3 THEN 100 + b WHEN c <= 3 THEN 200 + c ELSE 1000 + o END AS turn, split_part(file_path, '/', 2) AS folder FROM f1),
    f3 AS (SELECT *, row_number() OVER (PARTITION BY request, folder ORDER BY turn) > 2 AND NOT coalesce(a <= 3, false) AS later FROM f2),
    f4 AS (SELECT * FROM f3 QUALIFY row_number() OVER (PARTITION BY request ORDER BY later, turn) <= 8),
    files AS (SELECT request, file_path, row_number() OVER (PARTITION BY request ORDER BY score DESC, first, file_path) AS file_rank, score, coverage, count(*) OVER (PARTITION BY request) AS n FROM f4),
    placed AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS r, count(*) OVER (PARTITION BY file_path) AS many FROM sym WHERE symbol_type IN ('function', 'method')),
    found AS (SELECT request, id, h.score AS direct, exact, row_number() OVER (PARTITION BY request ORDER BY rank) <= 32 AS pref FROM hits h JOIN files USING (request, file_path) WHERE kind = 'symbol'),
    p0 AS (SELECT request, file_rank, coverage, placed.*, coalesce(direct, 0.0) AS direct, coalesce(exact, false) AS exact, CASE WHEN pref THEN 0 ELSE 1 END AS pref, (128 + n - 1) // n AS share
        FROM files JOIN placed USING (file_path) LEFT JOIN found USING (request, id)),
    p1 AS (SELECT *, row_number() OVER (PARTITION BY request, file_path, least(share - 1, (r - 1) * share // many) ORDER BY pref, r, id) AS nth FROM p0),
    p2 AS (SELECT *, row_number() OVER (PARTITION BY request, file_path ORDER BY pref, nth, r, id) AS slot FROM p1 WHERE pref = 0 OR nth = 1),
    pool AS (SELECT *, 0 AS graph_depth, 0.0 AS graph_confidence FROM p2 WHERE slot <= share QUALIFY row_number() OVER (PARTITION BY request ORDER BY slot, file_path, start_line, id) <= 128),
    {_ranked("initial", "pool")},
    seeds AS (SELECT request, id, file_path, row_number() OVER (PARTITION BY request ORDER BY told DESC, CASE WHEN told THEN -direct END, CASE WHEN told THEN NOT (named OR exact) END, CASE WHEN told THEN -(hits > 0)::INT END,
            CASE WHEN told THEN -score END, CASE WHEN told THEN id END, place) AS seed
        FROM (SELECT *, direct > 0 OR hits > 0 OR named OR exact AS told FROM initial) QUALIFY seed <= 6),
    links AS (SELECT source + 1 AS source, target + 1 AS target, relation, confidence FROM {EDGES_SQL} WHERE valid_to IS NULL AND relation IN ('calls', 'renders_component')),
    d0 AS (SELECT request, source AS id, 0 AS flow, max(confidence) AS graph_confidence FROM links JOIN (SELECT request, id AS target FROM seeds) USING (target) GROUP BY ALL),
    parts AS (SELECT DISTINCT request, c.id AS target FROM sym c JOIN seeds USING (file_path) WHERE c.symbol_type = 'component'),
    shown AS (SELECT request, s.file_path, max(confidence) AS graph_confidence FROM links JOIN parts USING (target) JOIN sym s ON s.id = source WHERE relation = 'renders_component' GROUP BY ALL),
    d1 AS (SELECT request, id, 0 AS flow, graph_confidence FROM d0 WHERE id IN (SELECT id FROM placed)
        UNION ALL SELECT request, id, 1, graph_confidence FROM shown JOIN (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) = 1) USING (file_path)),
    d2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY request ORDER BY flow, graph_confidence DESC, id) <= 16),
    owners AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY request, id ORDER BY flow) = 1),
    every AS (SELECT * EXCLUDE (share, slot, nth, pref, r, many) FROM pool UNION ALL BY NAME
        SELECT request, 9 AS file_rank, 0 AS coverage, sym.*, 0.0 AS direct, false AS exact, 1 AS graph_depth, graph_confidence FROM owners JOIN sym USING (id)),
    {_ranked("final", "every")},
    callables AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY later, place) AS choice FROM (SELECT *, row_number() OVER (PARTITION BY request, file_path ORDER BY place) > 2 AS later FROM final) QUALIFY choice <= 12),
    ranges AS (
        SELECT request, id, file_path, symbol, choice, CASE WHEN hits > 0 THEN greatest(start_line, line - 2) ELSE start_line END AS a, CASE WHEN hits > 0 THEN least(end_line, line + 2) ELSE end_line END AS b
        FROM (SELECT *, least(end_line, greatest(start_line, mechanism_line)) AS line FROM callables WHERE start_line > 0 AND end_line >= start_line) QUALIFY row_number() OVER (PARTITION BY request ORDER BY choice) <= 8)"""


@query("rk33_localised", f"""WITH {STAGES_SQL}
    SELECT request, 'file' AS stage, file_rank AS place, NULL::BIGINT AS id, file_path, score, NULL AS start_line, NULL AS end_line FROM files
    UNION ALL SELECT request, 'pool', file_rank, id, file_path, direct, NULL, NULL FROM pool
    UNION ALL SELECT request, 'seed', seed, id, file_path, NULL, NULL, NULL FROM seeds
    UNION ALL SELECT request, 'owner', 1, id, file_path, graph_confidence, NULL, NULL FROM owners JOIN sym USING (id)
    UNION ALL SELECT request, 'callable', choice, id, file_path, score, start_line, end_line FROM callables
    UNION ALL SELECT request, 'range', choice, id, file_path, NULL, a, b FROM ranges""")
def _(s, d):
    return located(s, d)[1].stages()


@query("rk35_callable_evidence", f"""WITH {STAGES_SQL},
    e0 AS (SELECT c.*, r.request IS NOT NULL AS located, coalesce(owner_kind, '') AS k FROM callables c LEFT JOIN (SELECT DISTINCT request, file_path, symbol FROM ranges) r USING (request, file_path, symbol)),
    e1 AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY request, file_path, k ORDER BY choice) = 1),
    e2 AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY choice) AS n, greatest(0, CASE WHEN evidence <> 0 THEN evidence ELSE score END) AS ev FROM e1 QUALIFY n <= 3),
    e3 AS (SELECT p.request, p.id AS "primary", p.located, p.target_match, p.kind_match, p.score, p.ev, p.coverage, p.k,
            coalesce((SELECT list(o.id ORDER BY n) FROM e2 o WHERE o.request = p.request AND n > 1), []) AS alternatives,
            (SELECT count(*) FROM e2 o WHERE o.request = p.request AND n > 1 AND o.k = p.k) AS same, (SELECT max(o.coverage) FROM e2 o WHERE o.request = p.request AND n > 1 AND o.k = p.k) AS most,
            coalesce((SELECT o.score FROM e2 o WHERE o.request = p.request AND n = 2), 0) AS next_score, coalesce((SELECT o.ev FROM e2 o WHERE o.request = p.request AND n = 2), 0) AS next_ev FROM e2 p WHERE n = 1)
    SELECT req.request, CASE WHEN "primary" IS NULL THEN 'unavailable' WHEN located AND (((target_match OR kind_match) AND same = 0) OR (target_match AND coverage > 0 AND same > 0 AND coverage > most)
            OR (CASE WHEN target_match THEN score >= next_score + 2 ELSE ev >= next_ev + 2 END)) THEN 'bounded' ELSE 'uncertain' END AS certainty, "primary", coalesce(array_to_string(alternatives, ','), '') AS alternatives
    FROM req LEFT JOIN e3 USING (request)""")
def _(s, d):
    asked, found = located(s, d)
    return localize.callable_evidence(found.callables, found.ranges, asked).withColumn("alternatives", F.array_join(F.col("alternatives").cast("array<string>"), ","))


# --- focus ------------------------------------------------------------------------------------------------------------

_R = "request % 12"
#: What a request adds to its words so that another rule decides it.
_ADDED = f"""CASE {_R} WHEN 0 THEN ' Brand1Service Brand2Service Brand3Service Brand7Service' WHEN 2 THEN ' bind callback read storage' WHEN 3 THEN ' state update guard' WHEN 5 THEN ' state update guard read storage'
    WHEN 7 THEN ' openPage' WHEN 8 THEN ' shared' ELSE '' END"""
#: Columns of the rows that a request recalled, but for the reasons; `pos` is the place.
ITEM = {
    "symbol": "concat('Brand', replace(replace(file_path, concat('src/', business_terms, '/Brand'), ''), '.ts', ''), 'Service')",
    "summary": "concat('part', CASE WHEN id % 2 = 0 THEN ' state_write' ELSE '' END, CASE WHEN id % 3 = 0 THEN ' guard persistenceread' ELSE '' END, CASE WHEN id % 5 = 0 THEN ' uicallbackbinding setstate' ELSE '' END)",
    "score": f"CASE WHEN pos > 1 AND ({_R} = 7 OR {_R} = 8 AND id % 4 > 0) THEN CAST(5 AS DOUBLE) ELSE score END",
    "method_coverage": f"CASE WHEN {_R} IN (4, 7) THEN CASE WHEN pos = 1 THEN 4 ELSE CAST(id % 5 AS INT) END END",
    "behaviour_coverage": f"CASE WHEN {_R} = 3 THEN CAST(id % 4 AS INT) END",
}
REASONS = {
    "exact_symbol": f"exact AND {_R} <> 4", "caller_owner": f"{_R} = 1 AND id % 7 = 0", "semantic_behavior": f"{_R} = 3 AND id % 2 = 1", "multi_term_method_evidence": f"{_R} = 4", "structural_behavior": f"{_R} = 5 OR {_R} = 4 AND request > 12 AND id % 8 = 0",
    "exact_behavior_operation": f"{_R} = 6 AND id % 5 = 0", "exact_path_segment": f"{_R} IN (7, 9) AND (id % 3 = 0 OR pos = 1)", "multi_concept_coverage": f"{_R} = 8 AND (pos = 1 OR id % 4 = 0)",
    "graph_relation:renders_component": f"{_R} = 10 AND id % 4 = 0", "graph_neighbor": "id % 9 = 4",
}


def items(asked: DataFrame, recalled: DataFrame, found: DataFrame, most: int = 30) -> DataFrame:
    """The first rows of each request, with their reasons."""
    rows = sent(written(recalled.where(F.col("rank") <= most))).join(found.select("id", "business_terms"), "id").withColumnRenamed("rank", "pos")
    reasons = F.array_compact(F.array(*(F.when(F.expr(v), k) for k, v in REASONS.items())))
    lanes = F.when((F.col("id") % 2 == 0) | (F.col("pos") == 1), F.array(F.lit("method_body_fts")))
    return rows.select("request", F.col("pos").alias("position"), "id", "file_path", *(F.expr(v).alias(k) for k, v in ITEM.items()), reasons.alias("reasons"), lanes.alias("lanes"))


def _has_sql(*reasons: str) -> str:
    return f"list_has_any(reasons, {list(reasons)})"


_FLOWS, _STRONG, _IDENTITY = (_has_sql(*x) for x in (("graph_relation:passes_property", "graph_relation:renders_component"), ("exact_symbol", "exact_file_path", "exact_identifier", "exact_path_segment"), ("exact_symbol", "exact_file_path", "exact_identifier")))
_FOCUS_SQL = f"""{STAGES_SQL.split("f0 AS (")[0].rstrip().rstrip(",")},
    i0 AS (SELECT request, id, h.file_path, h.score, exact, rank AS pos, business_terms FROM hits h JOIN sym USING (id) WHERE rank <= 30),
    i1 AS (SELECT request, pos, id, file_path, {', '.join(f'{v} AS {k}' for k, v in ITEM.items())}, list_filter([{', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in REASONS.items())}], lambda x: x IS NOT NULL) AS reasons, (id % 2 = 0 OR pos = 1) AS body FROM i0),
    q AS (SELECT request, concat(query, {_ADDED}) AS query FROM req),
    g AS (SELECT request, query, list_filter([CASE WHEN contains(query, 'state update') THEN 'state_write' END, CASE WHEN contains(query, 'state update') THEN 'setstate' END, CASE WHEN contains(query, 'guard') THEN 'guard' END,
        CASE WHEN contains(query, 'read storage') THEN 'persistenceread' END, CASE WHEN contains(query, 'bind callback') THEN 'uicallbackbinding' END], lambda x: x IS NOT NULL) AS marks FROM q),
    i2 AS (SELECT i1.*, query, list_intersect(marks, string_split(summary, ' ')) AS own, len(marks) + CASE WHEN contains(query, 'guard') THEN 1 ELSE 0 END AS n_marks FROM i1 JOIN g USING (request)),
    i3 AS (SELECT *, len(list_intersect(own, ['persistenceread', 'platformsensitiveui', 'uicallbackbinding'])) AS contracts, regexp_matches(query, '\\bopenPage\\b|BrandStore') AND contains(query, 'openPage') AS member,
        contains(query, 'Brand1Service') AND symbol IN ('Brand1Service', 'Brand2Service', 'Brand3Service', 'Brand7Service') AS named, coalesce(method_coverage >= 3, false) AND {_has_sql('multi_term_method_evidence')} AS m FROM i2),
    i4 AS (SELECT *, contracts > 0 AND contracts = max(contracts) OVER r AS c, member AND coalesce(method_coverage, 0) >= 2 AND body AND {_has_sql('exact_path_segment')} AS e, max(score) FILTER (m) OVER r AS top,
            bool_or(m) OVER (PARTITION BY request, file_path) AS inside, max(score) FILTER (pos = 1) OVER r AS lead, max(score) FILTER (pos = 2) OVER r AS second, bool_or({_has_sql('multi_concept_coverage')}) FILTER (pos = 1) OVER r AS leads,
            bool_or({_FLOWS}) OVER r AS flows, min(pos) FILTER (NOT {_FLOWS}) OVER r AS other,
            count(DISTINCT file_path) FILTER (named) OVER r AS named_paths, count(DISTINCT file_path) FILTER ({_STRONG}) OVER r AS strong_paths, count(DISTINCT file_path) FILTER ({_IDENTITY}) OVER r AS identity_paths, count(DISTINCT file_path) FILTER ({_FLOWS}) OVER r AS flow_paths
        FROM i3 WINDOW r AS (PARTITION BY request)),
    i5 AS (SELECT *, max(score) FILTER (c) OVER r AS c_top, e AND row_number() OVER (PARTITION BY request, e ORDER BY score DESC, pos) = 1 AS owner,
            bool_or(NOT inside AND CASE WHEN {_has_sql('exact_symbol', 'multi_concept_coverage', 'graph_relation:renders_component')} THEN score >= top * 0.85 ELSE {_has_sql('structural_behavior')} AND score >= greatest(12, top * 0.85) END) OVER r AS rivalled
        FROM i4 WINDOW r AS (PARTITION BY request)),
    i6 AS (SELECT *, max(score) FILTER (NOT owner AND NOT {_has_sql('graph_neighbor')}) OVER (PARTITION BY request) AS rival, c AND score >= c_top * 0.85 AS c2,
            n_marks >= 2 AND coalesce(behaviour_coverage, 0) >= 2 AND behaviour_coverage = max(behaviour_coverage) OVER (PARTITION BY request) AND {_has_sql('semantic_behavior')} AS b2, m AND score >= top * 0.75 AND NOT coalesce(rivalled, false) AS m2 FROM i5),
    i7 AS (SELECT *, min(pos) FILTER (c2) OVER w AS pc, min(pos) FILTER (b2) OVER w AS pb, min(pos) FILTER (m2) OVER w AS pm FROM i6 WINDOW w AS (PARTITION BY request, file_path)),
    i8 AS (SELECT *, c2 AND dense_rank() OVER (PARTITION BY request, c2 ORDER BY pc) <= 2 AS f2, b2 AND dense_rank() OVER (PARTITION BY request, b2 ORDER BY pb) <= 2 AS f3, m2 AND dense_rank() OVER (PARTITION BY request, m2 ORDER BY pm) <= 3 AS f4 FROM i7),
    s0 AS (SELECT request, pos, own, row_number() OVER (PARTITION BY request ORDER BY len(own) DESC, pos) AS n FROM i8 WHERE len(own) > 0 AND {_has_sql('structural_behavior')}),
    s1 AS (SELECT request, 0 AS n, []::VARCHAR[] AS seen, []::BIGINT[] AS chosen FROM g
        UNION ALL SELECT s1.request, s1.n + 1, CASE WHEN len(chosen) < 3 AND NOT list_has_all(seen, own) THEN list_distinct(list_concat(seen, own)) ELSE seen END, CASE WHEN len(chosen) < 3 AND NOT list_has_all(seen, own) THEN list_append(chosen, pos) ELSE chosen END
        FROM s1 JOIN s0 ON s0.request = s1.request AND s0.n = s1.n + 1),
    s2 AS (SELECT request, arg_max(chosen, n) AS chosen FROM s1 GROUP BY request),
    i9 AS (SELECT *, [named AND named_paths >= 2, {_has_sql('caller_owner')}, coalesce(f2, false), coalesce(f3, false), coalesce(f4, false), coalesce(list_contains(chosen, pos), false), {_has_sql('exact_behavior_operation')},
            coalesce(owner AND score >= greatest(12, coalesce(rival, 0) * 2), false), coalesce(contains(query, 'shared') AND leads AND second <= lead * 0.65 AND {_has_sql('multi_concept_coverage')} AND score >= lead * 0.75, false),
            {_STRONG} AND strong_paths >= 2 AND NOT flows, flows AND CASE WHEN identity_paths >= 2 THEN {_FLOWS} OR {_IDENTITY} ELSE flow_paths >= 2 AND ({_FLOWS} OR pos = other) END] AS f FROM i8 JOIN s2 USING (request)),
    i10 AS (SELECT *, coalesce(list_min([{', '.join(f'CASE WHEN bool_or(f[{i + 1}]) OVER r THEN {i} END' for i in range(11))}]), 11) AS rule FROM i9 WINDOW r AS (PARTITION BY request))"""


@query("rk36_code_focus", f"WITH RECURSIVE {_FOCUS_SQL} SELECT request, pos AS position, id, {list(focus.RULES)}[rule + 1] AS rule FROM i10 WHERE rule = 11 OR f[rule + 1]")
def _(s, d):
    asked, found = requests(s, d), symbols(s, d)
    told = items(asked, hits(asked, found), found)
    return focus.focus(told, asked.withColumn("query", F.concat("query", F.expr(_ADDED)))).select("request", "position", "id", "rule")


# --- the seven lanes ----------------------------------------------------------------------------------------------------

#: The bags of terms of a symbol's passage, and of a file's, as Spark and DuckDB read alike.
_BAGS = {
    "file_path": "file_path", "symbol": "symbol", "identity_terms": "concat(replace(symbol, '_', ' '), ' ', owner_name)", "semantic_terms": "concat(coalesce(business_summary, ''), ' ', business_terms)", "body_terms": "method_evidence",
    "string_terms": "string_evidence", "mechanism_terms": "CASE WHEN mechanism_line IS NOT NULL THEN concat('state_write ', mechanism_term) END",
}
_FILE_BAGS = dict.fromkeys(_BAGS, "CAST(NULL AS VARCHAR(9))") | {"file_path": "file_path", "identity_terms": "replace(file_path, '/', ' ')", "semantic_terms": "concat(max(business_terms), ' file')"}
_SOUGHT, _LIMIT = ["small", "ring", "econ", "state", "brandstore7", "brand"], 40
_PASSAGE_KIND = "CASE WHEN symbol_type IN ('function', 'method') THEN 'callable' ELSE 'symbol' END"
_PASSAGES_SQL = f"""SELECT id, {_PASSAGE_KIND} AS kind, {', '.join(f'{v} AS {k}' for k, v in _BAGS.items())} FROM {SYMBOLS_SQL}
    UNION ALL SELECT -min(id), 'file', {', '.join(f'{v} AS {k}' for k, v in _FILE_BAGS.items())} FROM {SYMBOLS_SQL} GROUP BY file_path"""
_CHANNELS_SQL = f"""passages AS ({_PASSAGES_SQL}), t AS ({' UNION ALL '.join(f"SELECT id, '{f}' AS field, unnest({sql_tokens(f)}) AS term FROM passages" for f in _BAGS)}), dl AS (SELECT id, count(*) AS doc_len FROM t GROUP BY id),
    n AS (SELECT (SELECT count(*) FROM passages) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM passages) AS mean_len), {', '.join(
        sql_bm25("", _SOUGHT, w, 32 if c in index.IDENTITIES else 20, out=c, among=f"WHERE id IN (SELECT id FROM passages WHERE kind IN ({', '.join(f"'{k}'" for k in index.KINDS[c])}))") for c, w in index.LANES.items())},
    ranked AS ({' UNION ALL '.join(f"SELECT '{c}' AS channel, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {c}" for c in index.LANES)})"""


def _channels(s, d):
    rows = table(s, d, "part").selectExpr(*(f"{v} AS {k}" for k, v in SYMBOL.items()))
    told = rows.selectExpr("id", f"{_PASSAGE_KIND} AS kind", *(f"{v} AS {k}" for k, v in _BAGS.items()))
    files = rows.groupBy("file_path").agg((-F.min("id")).alias("id"), F.lit("file").alias("kind"), F.max("business_terms").alias("most"))
    files = files.selectExpr("id", "kind", *(f"{v.replace('max(business_terms)', 'most')} AS {k}" for k, v in _FILE_BAGS.items()))
    passages = told.unionByName(files)
    found = index.postings(passages, list(_BAGS))
    lengths = passages.select(index.passage_length(list(_BAGS)).alias("l")).agg(F.count("*").alias("n"), F.avg("l").alias("mean_len"))
    return index.channels(written(found), written(lengths), passages.select("id", "kind"), _SOUGHT, _LIMIT)


@query("rk06_seven_channels", f"WITH {_CHANNELS_SQL} SELECT channel, id, rank FROM ranked")
def _(s, d):
    return _channels(s, d)


@query("rk07_fused_channels", f"WITH {_CHANNELS_SQL} SELECT id, round(sum(1 / (60 + rank)), 9) AS score, string_agg(channel, ',' ORDER BY channel) AS lanes FROM ranked GROUP BY id ORDER BY score DESC, min(rank), id LIMIT 40")
def _(s, d):
    return index.attributed(_channels(s, d), dict.fromkeys(index.LANES, 1.0), 40)
