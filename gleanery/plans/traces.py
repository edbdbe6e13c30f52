"""Recall of incidents made of events, for requests made of nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incidents, index, mechanism
from ..sources.records import table
from ..streaming import cohort
from ..streaming import events as streams
from . import views
from .bound import query
from .kept import _stream
from .recall import sql_tokens
from .views import LINES_SQL

#: An incident of a log line, as expressions that Spark and DuckDB read alike.
INCIDENT = {
    "id": "event_id", "symptom": "line", "goal": "CASE WHEN event_id % 3 = 0 THEN 'diagnosis' END", "scene": "event_type", "dominant_log_events": "concat('user', user_id % 40, ' saw ', event_type)",
    "diagnosis_summary": "CASE WHEN event_id % 4 = 0 THEN 'Timeout behind the gateway_proxy' END", "causal_chain": "CASE WHEN event_id % 5 = 0 THEN concat('step', event_id % 30, ' then retry') END", "resolution": "CASE WHEN event_id % 7 = 0 THEN 'restart' END",
    "intervention": "CAST(NULL AS VARCHAR(9))", "verification_evidence": "CAST(NULL AS VARCHAR(9))", "status": "CASE event_id % 11 WHEN 0 THEN 'stale' WHEN 1 THEN 'ignored' ELSE 'open' END",
    "capture_mode": "CASE WHEN event_id % 13 = 0 THEN 'manual' ELSE 'agent_structured' END", "confidence": "(event_id % 10) / 10.0", "updated_at": "event_id % 1000",
}
#: Requests: words, numbers of users, parts of words (which no word equals), and what nothing holds.
REQUEST = "CASE n_nationkey % 6 WHEN 0 THEN 'load profile failed' WHEN 1 THEN concat('user', n_nationkey, ' retry') WHEN 2 THEN concat('teway_pro', CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE 'x' END) WHEN 3 THEN concat('tep', n_nationkey % 30) WHEN 4 THEN 'qqq' ELSE 'Session invalid' END"
_INCIDENTS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in INCIDENT.items()) + f" FROM {LINES_SQL})"
_MATCH = "CASE WHEN length(t) <= 3 THEN regexp_matches(text, concat('(^|[^a-z0-9])', t, '([^a-z0-9]|$)')) ELSE contains(text, t) END"


def made(s, d):
    rows = views.lines(s, d).selectExpr(*(f"{v} AS {k}" for k, v in INCIDENT.items()))
    return rows.withColumn("confidence", F.col("confidence").cast("double"))


@query("rk21_incident_recall", f"""WITH i AS {_INCIDENTS_SQL}, r AS (SELECT n_nationkey AS request, {REQUEST} AS query FROM nation),
    o AS (SELECT * FROM i WHERE status NOT IN ('stale', 'ignored') AND capture_mode = 'agent_structured'),
    w AS (SELECT DISTINCT request, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS t FROM r),
    q AS (SELECT * FROM w UNION SELECT request, unnest(string_split(t, '_')) FROM w WHERE contains(t, '_')),
    p AS ({' UNION ALL '.join(f"SELECT id, unnest({sql_tokens(f)}) AS t FROM i" for f in incidents.FIELDS)}), l AS (SELECT id, count(*) AS doc_len FROM p GROUP BY id),
    n AS (SELECT (SELECT count(*) FROM i) AS n, (SELECT count(*) FROM p) / (SELECT count(*) FROM i) AS mean_len),
    h AS (SELECT id, t, count(*) AS f FROM p WHERE t IN (SELECT t FROM q) GROUP BY ALL), d AS (SELECT t, count(*) AS df FROM h GROUP BY t),
    b AS (SELECT request, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 6) AS bm25 FROM q JOIN d USING (t) JOIN h USING (t) JOIN l USING (id), n WHERE id IN (SELECT id FROM o) GROUP BY ALL),
    f AS (SELECT request, id FROM b QUALIFY row_number() OVER (PARTITION BY request ORDER BY bm25 DESC, id) <= 24),
    k AS (SELECT request, id FROM r, o WHERE request NOT IN (SELECT request FROM f) AND (contains(lower(coalesce(symptom, '')), lower(query)) OR contains(lower(coalesce(dominant_log_events, '')), lower(query)) OR contains(lower(coalesce(diagnosis_summary, '')), lower(query)) OR contains(lower(coalesce(causal_chain, '')), lower(query)))
        QUALIFY row_number() OVER (PARTITION BY request ORDER BY updated_at DESC, id DESC) <= 24),
    x AS (SELECT request, o.*, query, lower(concat_ws(' ', symptom, coalesce(goal, ''), scene, dominant_log_events, coalesce(diagnosis_summary, ''), coalesce(causal_chain, ''), coalesce(resolution, ''), '', '')) AS text FROM (FROM f UNION ALL FROM k) JOIN o USING (id) JOIN r USING (request)),
    s AS (SELECT x.request, id, updated_at, confidence, contains(lower(symptom), lower(query)) OR contains(lower(query), lower(symptom)) AS exact, count(*) FILTER ({_MATCH}) AS hits, count(*) FILTER ({_MATCH} AND NOT EXISTS (FROM w WHERE w.request = x.request AND w.t = q.t)) AS extra FROM x JOIN q USING (request) GROUP BY ALL),
    z AS (SELECT request, id, round(hits * 1.2 + CASE WHEN exact THEN 5 ELSE 0 END + confidence, 2) AS score, concat_ws(',', CASE WHEN exact THEN 'exact_incident_symptom' END, CASE WHEN extra > 0 THEN 'expanded_query:incident_trace' WHEN hits > 0 THEN 'incident_trace' END) AS reasons, updated_at FROM s WHERE hits > 0 OR exact),
    y AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, updated_at DESC, id DESC) AS place FROM z QUALIFY place <= 8),
    e AS (SELECT event_id % 500 AS trace_id, event_id AS id, value AS score FROM events),
    j AS (SELECT trace_id, list(id ORDER BY score DESC, id DESC) AS links FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, id DESC) <= 12) GROUP BY trace_id)
    SELECT request, y.id, score, reasons, place, coalesce(array_to_string(links, ','), '') AS links FROM y LEFT JOIN j ON trace_id = y.id""")
def _(s, d):
    rows = made(s, d)
    fields = list(incidents.FIELDS)
    postings = index.postings(rows, fields)
    lengths = rows.select(index.passage_length(fields).alias("l")).agg(F.count("*").alias("n"), F.avg("l").alias("mean_len"))
    asked = table(s, d, "nation").selectExpr("n_nationkey AS request", f"{REQUEST} AS query")
    found = incidents.recall(asked, rows, postings, lengths, 8)
    links = table(s, d, "events").selectExpr("event_id % 500 AS trace_id", "event_id AS id", "value AS score")
    return incidents.with_links(found, links).select("request", "id", "score", F.array_join("reasons", ",").alias("reasons"), "place", F.array_join(F.col("links").cast("array<string>"), ",").alias("links"))


# --- mechanisms ---------------------------------------------------------------------------------------------------------

#: Items of an order assert, or show, spans of lines of a file.
_SPAN = {"case": "l_orderkey", "file_path": "concat('f', l_partkey % 2)", "symbol": "CASE WHEN l_suppkey % 3 = 0 THEN concat('S', l_suppkey % 2) ELSE '' END", "a": "CAST(l_quantity * 3 AS INT)", "b": "CAST(l_quantity * 3 + l_partkey % 90 - 5 AS INT)"}
_SPANS_SQL = f"SELECT {', '.join(f'{v} AS {k}' for k, v in _SPAN.items())}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS assertion FROM lineitem"
_LEVEL = "CASE {0} % 6 WHEN 0 THEN 'association' WHEN 1 THEN 'Supported' WHEN 2 THEN 'verified' WHEN 3 THEN 'rejected' WHEN 4 THEN 'guess' END"


@query("xo22_mechanism_cover", f"""WITH s AS ({_SPANS_SQL}), e AS (SELECT DISTINCT "case", file_path, symbol, a AS x, b AS y FROM s WHERE assertion % 2 = 0 AND a > 0 AND b >= a), t AS (SELECT * FROM s WHERE assertion % 2 = 1),
    m AS (SELECT t.case, t.assertion, unnest(generate_series(greatest(t.a, e.x), least(t.b, e.y))) AS line FROM t JOIN e ON e.case = t.case AND e.file_path = t.file_path AND (t.symbol = '' OR t.symbol = e.symbol) AND t.a <= e.y AND t.b >= e.x WHERE t.a > 0 AND t.b >= t.a),
    c AS (SELECT "case", assertion, count(DISTINCT line) AS covered FROM m GROUP BY ALL),
    k AS (SELECT t.case, count(*) AS expected, count(covered) AS matched, sum(greatest(0, b - a + 1)) AS lines, coalesce(sum(covered), 0) AS covered FROM t LEFT JOIN c USING ("case", assertion) GROUP BY ALL),
    o AS (SELECT o_orderkey AS "case", lower({_LEVEL.format("o_custkey")}) AS want, lower({_LEVEL.format("o_orderkey")}) AS got, ['association', 'supported', 'verified'] AS l FROM orders)
    SELECT o.case, coalesce(expected, 0) AS expected, coalesce(matched, 0) AS matched, round(matched / expected, 4) AS score, matched = expected AS grounded, CASE WHEN lines > 0 THEN round(covered / lines, 4) END AS cover,
        CASE WHEN want IS NULL THEN true WHEN list_contains(l, want) AND coalesce(list_contains(l, got), false) THEN list_position(l, got) >= list_position(l, want) ELSE coalesce(got, '') = want END AS level_ok FROM o LEFT JOIN k USING ("case")""")
def _(s, d):
    spans = s.sql(_SPANS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(s, d, "lineitem"))
    cases = table(s, d, "orders").selectExpr("o_orderkey AS case", f"{_LEVEL.format('o_custkey')} AS expected_level", f"{_LEVEL.format('o_orderkey')} AS observed_level")
    shown = spans.where("assertion % 2 = 0").select("case", "file_path", "symbol", F.col("a").alias("x"), F.col("b").alias("y"))
    return mechanism.scored(cases, spans.where("assertion % 2 = 1"), shown)


# --- cohorts ------------------------------------------------------------------------------------------------------------

PLACES = 8
#: Events of users as entries and completions of cohorts; `at` counts microseconds.
_COHORT = {
    "cohort": "user_id % 5", "event_id": "event_id", "kind": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'complete' ELSE 'enrol' END", "task_id": "concat('t', user_id)", "eligibility": "CASE event_type WHEN 'error' THEN 'excluded' ELSE 'eligible' END",
    "outcome": "event_type",
}


def cohort_events(rows):
    at = F.unix_micros("ts").alias("at")
    return rows.select(*(F.expr(v).alias(k) for k, v in _COHORT.items()), at, (F.unix_micros("ts") + F.when(F.col("event_id") % 9 == 0, 1).otherwise(-1)).alias("evidence_at"))


@query("st09_cohorts", f"""WITH RECURSIVE e AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _COHORT.items())}, epoch_us(ts) AS moment, epoch_us(ts) + CASE WHEN event_id % 9 = 0 THEN 1 ELSE -1 END AS evidence_at FROM events),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY moment, event_id) AS n FROM e),
    w AS (SELECT DISTINCT cohort, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS kind, '' AS task_id, '' AS reason, 0 AS sequence, '' AS digest, '' AS previous, '' AS active, '' AS entry, '' AS head, []::VARCHAR[] AS seen FROM e
        UNION ALL SELECT cohort, n, event_id, kind, task_id, reason, sequence + enters::INT, CASE WHEN ends THEN sha256(concat(entry, '|', outcome)) WHEN enters THEN fresh ELSE '' END, CASE WHEN ends THEN entry WHEN enters THEN head ELSE '' END,
            CASE WHEN ends THEN '' WHEN enters AND eligibility = 'eligible' THEN task_id ELSE active END, CASE WHEN ends THEN '' WHEN enters AND eligibility = 'eligible' THEN fresh ELSE entry END, CASE WHEN enters THEN fresh ELSE head END, CASE WHEN enters THEN list_append(seen, task_id) ELSE seen END
        FROM (SELECT *, reason = 'taken' AND kind = 'complete' AS ends, reason = 'taken' AND kind = 'enrol' AS enters, sha256(concat_ws('|', cohort, sequence + 1, task_id, eligibility, moment, head)) AS fresh
            FROM (SELECT o.*, w.sequence, w.active, w.entry, w.head, w.seen, CASE WHEN sequence >= {PLACES} AND active = '' THEN 'finished' WHEN o.kind = 'complete' THEN CASE WHEN active = o.task_id THEN 'taken' ELSE 'not_open' END WHEN active <> '' THEN 'open_task'
                WHEN sequence >= {PLACES} THEN 'full' WHEN list_contains(seen, o.task_id) THEN 'known_task' WHEN evidence_at > moment THEN 'evidence_after_cutoff' ELSE 'taken' END AS reason FROM w JOIN o ON o.cohort = w.cohort AND o.n = w.n + 1)))
    SELECT cohort, event_id, kind, task_id, reason, sequence, digest, previous, CASE WHEN sequence >= {PLACES} AND active = '' THEN 'completed' WHEN sequence > 0 THEN 'running' ELSE 'open' END AS status FROM w WHERE n > 0""")
def _(s, d):
    rows, folder = _stream(s, d)
    return streams.run_once(cohort.enrolled(cohort_events(rows), PLACES), folder)
