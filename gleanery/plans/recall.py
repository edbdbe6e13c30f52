"""Retrieval over a written index, rescoring, feedback, and the text functions behind them, bound to the driver's tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adjustments, graph, index, logs, scoring, upkeep
from ..sources.records import table
from . import views
from .bound import query
from .views import FEEDBACK_SQL, LINES_SQL, PATHS_SQL

_INDEXES: dict[tuple[str, str, str], str] = {}
FIELDS = {"part": {"file_path": "p_type", "symbol": "p_brand", "identity_terms": "p_name"}, "documents": {"identity_terms": "concat(source, ' ', coalesce(lang, ''))", "body_terms": "text"}}
KEYS = {"part": "p_partkey", "documents": "doc_id"}


def passages(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, name).selectExpr(f"{KEYS[name]} AS id", *(f"{v} AS {k}" for k, v in FIELDS[name].items()))


def indexed(s: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of a table, written once a session and folder."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        path = f"{graph.shared_folder(s)}/index-{uuid.uuid4().hex}"
        index.write_index(passages(s, d, name), list(FIELDS[name]), path)
        _INDEXES[key] = path
    return s.read.parquet(f"{_INDEXES[key]}/postings"), s.read.parquet(f"{_INDEXES[key]}/lengths")


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def sql_postings(name: str) -> str:
    each = " UNION ALL ".join(f"SELECT {KEYS[name]} AS id, '{f}' AS field, unnest({sql_tokens(v)}) AS term FROM {name}" for f, v in FIELDS[name].items())
    return f"t AS ({each}), dl AS (SELECT id, count(*) AS doc_len FROM t GROUP BY id), n AS (SELECT (SELECT count(*) FROM {name}) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM {name}) AS mean_len)"


def sql_bm25(name: str, terms: list[str], weights: dict[str, float], k: int, prefix: bool = True, every: bool = False, out: str = "r", among: str = "") -> str:
    listed = ", ".join(f"('{t}')" for t in terms)
    weight = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in weights.items()) + " END"
    match = "starts_with(t.term, q.q)" if prefix else "t.term = q.q"
    return f"""h_{out} AS (SELECT id, q, sum({weight}) AS f FROM t JOIN (VALUES {listed}) q(q) ON {match} WHERE field IN ({', '.join(f"'{f}'" for f in weights)}) GROUP BY id, q),
        d_{out} AS (SELECT q, count(*) AS df FROM h_{out} GROUP BY q),
        {out} AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 6) AS score, count(*) AS terms
            FROM h_{out} JOIN d_{out} USING (q) JOIN dl USING (id), n {among} GROUP BY id {f'HAVING count(*) = {len(terms)}' if every else ''} ORDER BY score DESC, id LIMIT {k})"""


# --- index and retrieval ---------------------------------------------------------------------------------------------


@query("rk01_postings", f"WITH {sql_postings('part')} SELECT field, term, count(DISTINCT id) AS df, count(*) AS tf FROM t GROUP BY field, term")
def _(s, d):
    return indexed(s, d, "part")[0].groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("rk04_prefix_match", f"WITH {sql_postings('part')} SELECT DISTINCT id FROM t WHERE starts_with(term, 'br') OR starts_with(term, 'wid')")
def _(s, d):
    found = indexed(s, d, "part")[0]
    return index.matches(found, ["br", "wid"], {f: 1.0 for f in FIELDS["part"]}, True).select("id").distinct()


@query("rk04_prefix_match_all", f"WITH {sql_postings('part')} SELECT id FROM t JOIN (VALUES ('re'), ('wid'), ('brand')) q(q) ON starts_with(term, q) GROUP BY id HAVING count(DISTINCT q) = 3")
def _(s, d):
    return index.prefix_coverage(indexed(s, d, "part")[0], ["re", "wid", "brand"], 3).select("id")


@query("rk05_indexed_bm25", f"WITH {sql_postings('documents')}, {sql_bm25('documents', ['the', 'und', 'para'], {'body_terms': 1.0}, 20, prefix=False)} SELECT id, score FROM r")
def _(s, d):
    return index.bm25(*indexed(s, d, "documents"), ["the", "und", "para"], {"body_terms": 1.0}, 20, prefix=False).select("id", "score")


TERMS = ["red", "widget", "econ", "brand"]
FIELDED = {"file_path": 2.0, "symbol": 8.0, "identity_terms": 10.0}


@query("rk06_fielded_bm25", f"WITH {sql_postings('part')}, {sql_bm25('part', TERMS, FIELDED, 32)} SELECT id, score FROM r")
def _(s, d):
    return index.bm25(*indexed(s, d, "part"), TERMS, FIELDED, 32).select("id", "score")


@query("rk07_conjunctive_lane", f"WITH {sql_postings('part')}, {sql_bm25('part', ['re', 'econ', 'brand'], FIELDED, 24, every=True)} SELECT id, score, terms FROM r")
def _(s, d):
    return index.bm25(*indexed(s, d, "part"), ['re', 'econ', 'brand'], FIELDED, 24, every=True)


LANES = {"identity": {"identity_terms": 9.0, "file_path": 6.0}, "symbol": {"symbol": 8.0}, "path": {"file_path": 1.0}}
_lane_sql = ", ".join(sql_bm25("part", TERMS, w, 16, out=c) for c, w in LANES.items())
_ranked_sql = " UNION ALL ".join(f"SELECT '{c}' AS channel, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {c}" for c in LANES)


@query("rk07_lanes", f"WITH {sql_postings('part')}, {_lane_sql} {_ranked_sql}")
def _(s, d):
    return index.lanes(*indexed(s, d, "part"), TERMS, LANES, 16)


@query("rk10_lane_attribution", f"""WITH {sql_postings('part')}, {_lane_sql}, a AS ({_ranked_sql})
    SELECT id, round(sum(CASE channel WHEN 'identity' THEN 1.4 WHEN 'symbol' THEN 1.1 ELSE 0.7 END / (60 + rank)), 9) AS score, string_agg(channel, ',' ORDER BY channel) AS lanes FROM a GROUP BY id ORDER BY score DESC, min(rank), id LIMIT 12""")
def _(s, d):
    return index.attributed(index.lanes(*indexed(s, d, "part"), TERMS, LANES, 16), {"identity": 1.4, "symbol": 1.1, "path": 0.7}, 12)


@query("rk08_recall_limits", """SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY n DESC, id) AS r FROM (
    SELECT 'facts' AS kind, doc_id AS id, n_chars AS n FROM documents UNION ALL SELECT 'files', p_partkey, p_size FROM part UNION ALL SELECT 'logs', event_id, value FROM events))
    WHERE r <= CASE kind WHEN 'facts' THEN 120 WHEN 'files' THEN 160 ELSE 180 END""")
def _(s, d):
    limits = {"facts": 120, "files": 160, "logs": 180}
    sources = {"facts": ("documents", "doc_id", "n_chars"), "files": ("part", "p_partkey", "p_size"), "logs": ("events", "event_id", "value")}
    lanes = [table(s, d, t).select(F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), F.col(n).alias("n")).orderBy(F.desc("n"), "id").limit(limits[kind]).drop("n") for kind, (t, i, n) in sources.items()]
    return reduce(DataFrame.union, lanes)


@query("rk11_method_evidence", f"WITH {sql_postings('part')} SELECT id, count(DISTINCT q) AS covered FROM t JOIN (VALUES ('sm'), ('rin'), ('eco'), ('zzz')) q(q) ON starts_with(term, q) GROUP BY id HAVING count(DISTINCT q) >= 2")
def _(s, d):
    return index.prefix_coverage(indexed(s, d, "part")[0], ["sm", "rin", "eco", "zzz"], 2)


def _count_sql(column: str, terms: list[str]) -> str:
    short = lambda t: f"regexp_matches(lower({column}), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" if len(t) <= 3 else f"contains(lower({column}), '{t}')"
    return "(" + " + ".join(f"CAST({short(t)} AS INTEGER)" for t in terms) + ")"


@query("rk12_weighted_field_reasons", f"""SELECT p_partkey, score, concat_ws(',', CASE WHEN e THEN 'exact_p_name' END, CASE WHEN n > 0 THEN CASE WHEN contains(lower(p_name), 'widget') THEN 'expanded_query:p_name' ELSE 'p_name' END END, CASE WHEN t > 0 THEN CASE WHEN contains(lower(p_type), 'widget') THEN 'expanded_query:p_type' ELSE 'p_type' END END) AS reasons
    FROM (SELECT *, CAST(CASE WHEN e THEN 4.0 ELSE 0.0 END + n * 2.0 + t * 1.5 AS DOUBLE) AS score FROM (SELECT p_partkey, p_name, p_type, contains(lower(p_name), 'red widget') OR contains('red widget', lower(p_name)) AS e, {_count_sql('p_name', ['red', 'econ', 'widget'])} AS n, {_count_sql('p_type', ['red', 'econ', 'widget'])} AS t FROM part)) WHERE score > 0""")
def _(s, d):
    scored = index.weighted_fields("Red Widget", ["red", "econ", "widget"], ["widget"], {"p_name": 2.0, "p_type": 1.5}, {"p_name": 4.0})
    return table(s, d, "part").select("p_partkey", *scored).where("score > 0")


@query("rk18_focus_coverage", f"SELECT p_partkey, CASE WHEN m > 0 THEN m * 8.0 + m / 3.0 * 12.0 + CASE WHEN m >= 2 THEN 8.0 ELSE 0 END ELSE 0 END AS bonus FROM (SELECT p_partkey, {_count_sql('p_name', ['red', 'small', 'widget'])} AS m FROM part)")
def _(s, d):
    return table(s, d, "part").select("p_partkey", index.focus_coverage(F.col("p_name"), ["red", "small", "widget"]).alias("bonus"))


@query("rk19_salience_bonus", f"SELECT item_id, CAST(least(18.0, 4.0 * (SELECT count(*) FROM (VALUES ('the'), ('ther'), ('on'), ('zzzz')) q(q) WHERE len(list_filter({sql_tokens('text')}, lambda w: CASE WHEN least(len(w), len(q)) < 3 THEN w = q ELSE starts_with(w, q) OR starts_with(q, w) END)) > 0)) AS DOUBLE) AS bonus FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", index.salience(T.tokens(F.col("text")), ["the", "ther", "on", "zzzz"]).alias("bonus"))


@query("rk19_identifier_identity", "SELECT p_partkey, CAST(least(6.0, CASE WHEN contains(lower(p_name), 'small') THEN 1.25 ELSE 0 END + CASE WHEN contains(lower(p_name), 'widget') THEN 1.5 ELSE 0 END) AS DOUBLE) AS bonus FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", index.identifier_identity(F.col("p_name"), ["small", "widget", "red"]).alias("bonus"))


@query("rk32_global_counts", "SELECT 'language' AS what, coalesce(lang, 'none') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY 2")
def _(s, d):
    count = lambda t, what, c: table(s, d, t).groupBy(F.coalesce(F.col(c), F.lit("none")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")
    return count("documents", "language", "lang").union(count("events", "event", "event_type"))


# --- feedback --------------------------------------------------------------------------------------------------------

_REASON = "CASE event_type WHEN 'error' THEN 'misleading' WHEN 'view' THEN 'stale' WHEN 'click' THEN 'overtrusted' WHEN 'signup' THEN 'undertrusted' ELSE 'verified_useful' END"
_SAID = "concat(event_type, ' failed pages ', CASE WHEN event_id % 3 = 0 THEN 'order' ELSE 'basket' END)"
ASKED = "error order"
_overlap_sql = "(SELECT *, len(list_intersect(q, ['error', 'order'])) / len(list_distinct(list_concat(q, ['error', 'order']))) AS overlap FROM (SELECT *, list_filter([event_type, 'failed', CASE WHEN event_id % 3 = 0 THEN 'order' ELSE 'basket' END], lambda x: true) AS q FROM {}))"


def _events(s, d):
    return views.feedback(s, d).join(table(s, d, "events").select("event_id", "event_type"), "event_id").withColumns({"reason": F.expr(_REASON), "query": F.expr(_SAID)})


_FEED_SQL = f"(SELECT f.*, e.event_type, {_REASON.replace('event_type', 'e.event_type')} AS reason FROM {FEEDBACK_SQL} f JOIN events e USING (event_id))"


def _confirmed_sql(kind: str, intrinsic: str = "") -> str:
    return f"SELECT record_id, {kind} AS kind, max(overlap) AS overlap FROM {_overlap_sql.format(_FEED_SQL)} WHERE overlap > 0 GROUP BY record_id, {kind} HAVING bool_or(verified) OR count(DISTINCT coalesce(CAST(task_id AS VARCHAR), 'legacy-event:' || event_id)) >= 2 {intrinsic}"


@query("ag15_feedback_penalty", f"""WITH c AS ({_confirmed_sql('reason', "OR reason = 'verified_useful'")})
    SELECT record_id, round(least(40.0, sum(CASE kind WHEN 'misleading' THEN 30.0 WHEN 'stale' THEN 24.0 WHEN 'overtrusted' THEN 18.0 ELSE 0.0 END * overlap)), 6) AS penalty,
        round(least(0.3, sum(CASE kind WHEN 'verified_useful' THEN 0.16 WHEN 'undertrusted' THEN 0.12 ELSE 0.0 END * overlap)), 6) AS trust_bonus, round(least(0.3, sum(CASE kind WHEN 'overtrusted' THEN 0.18 ELSE 0.0 END * overlap)), 6) AS trust_penalty FROM c GROUP BY record_id""")
def _(s, d):
    return adjustments.feedback_penalties(_events(s, d), ASKED)


@query("ag16_usage_adjustment", f"""WITH c AS ({_confirmed_sql('outcome')})
    SELECT record_id, round(least(0.18, sum(CASE kind WHEN 'helpful' THEN 0.18 ELSE 0.0 END * overlap)), 6) AS bonus, round(least(0.35, sum(CASE kind WHEN 'misleading' THEN 0.35 ELSE 0.0 END * overlap)), 6) AS penalty FROM c WHERE kind IN ('helpful', 'misleading') GROUP BY record_id""")
def _(s, d):
    return adjustments.usage_adjustments(_events(s, d), ASKED)


# --- text ------------------------------------------------------------------------------------------------------------


@query("fn02_identifier_parts", r"SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'), lambda x: len(x) > 0 AND x <> lower(c_name)), ' ') AS parts FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.array_join(T.identifier_parts(F.col("c_name")), " ").alias("parts"))


@query("fn02_camel_parts", "SELECT * FROM (VALUES ('parseHTTPResponse', 'parse http response'), ('snake_case', 'snake case'), ('plain', ''), ('X9Value', 'x9 value')) v(name, parts)")
def _(s, d):
    named = s.createDataFrame([(x,) for x in ("parseHTTPResponse", "snake_case", "plain", "X9Value")], "name string")
    return named.select("name", F.array_join(T.identifier_parts(F.col("name")), " ").alias("parts"))


_plain = "regexp_matches(w, '^[A-Za-z]{4,}$')"
_singular_sql = f"CASE WHEN {_plain} AND regexp_matches(w, '(ies|ied)$') AND len(w) > 4 THEN w[:-4] || 'y' WHEN {_plain} AND regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[:-2] ELSE w END"


@query("fn03_singular", f"SELECT w, {_singular_sql} AS singular, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS w FROM documents WHERE lang = 'en') GROUP BY ALL")
def _(s, d):
    words = table(s, d, "documents").where("lang = 'en'").select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).select("w", T.singular(F.col("w")).alias("singular"), "n")


_stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("fn04_significant_tokens", f"SELECT item_id, count(*) AS kept FROM (SELECT item_id, unnest({sql_tokens('text')}) AS w FROM benchmark) WHERE w NOT IN ({_stop}) AND (len(w) > 1 OR NOT regexp_matches(w, '^[\\x00-\\x7F]*$')) GROUP BY item_id")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("w")).where(T.significant(F.col("w"))).groupBy("item_id").agg(F.count("*").alias("kept"))


@query("fn05_expanded_query", "SELECT * FROM (VALUES ('日志 missing', '日志 missing log logger console hilog error warning exception failed failure debug'), ('the separators', 'separators separator divider strokewidth'), ('loadUser', 'loaduser load user')) v(q, terms)")
def _(s, d):
    asked = s.createDataFrame([("日志 missing",), ("the separators",), ("loadUser",)], "q string")
    return asked.select("q", F.array_join(T.query_tokens(F.col("q")), " ").alias("terms"))


@query("fn06_method_variants", "SELECT * FROM (VALUES ('running', 'running run'), ('loading', 'loading load'), ('applied', 'applied apply'), ('created', 'created creat'), ('ring', 'ring'), ('items', 'items item')) v(w, variants)")
def _(s, d):
    words = s.createDataFrame([(w,) for w in ("running", "loading", "applied", "created", "ring", "items")], "w string")
    return words.select("w", F.array_join(T.method_variants(F.col("w")), " ").alias("variants"))


@query("fn08_json_or_csv", "SELECT * FROM (VALUES ('[\"a\", \"b c\", \" \"]', 'a|b c'), (' x , y,,z ', 'x|y|z'), ('', ''), ('one', 'one')) v(t, listed)")
def _(s, d):
    return s.createDataFrame([('["a", "b c", " "]',), (" x , y,,z ",), ("",), ("one",)], "t string").select("t", F.array_join(T.json_or_csv(F.col("t")), "|").alias("listed"))


@query("fn09_token_match", f"SELECT p_partkey, {_count_sql('p_name', ['red', 'ring', 'big'])} AS hits FROM part")
def _(s, d):
    hit = [T.token_matches(F.lit(t), F.lower("p_name")).cast("int") for t in ("red", "ring", "big")]
    return table(s, d, "part").select("p_partkey", reduce(lambda x, y: x + y, hit).alias("hits"))


_generic = ", ".join(f"'{w}'" for w in T.GENERIC_PATH_TERMS)


@query("fn10_path_terms", f"SELECT page_id, array_to_string(list_sort(list_filter(list_distinct(regexp_split_to_array(lower(path), '[^a-z0-9]+')), lambda x: len(x) > 0 AND NOT list_contains([{_generic}], x))), ' ') AS terms FROM {PATHS_SQL}")
def _(s, d):
    return views.paths(s, d).select("page_id", F.array_join(F.array_sort(T.path_terms(F.col("path"))), " ").alias("terms"))


@query("fn12_phrase_in_text", r"SELECT item_id, contains(' ' || trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')) || ' ', ' of the ') AS has FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", T.phrase_in(F.lit("of the"), T.canonical(F.col("text"))).alias("has"))


@query("fn13_template_identity", "SELECT * FROM (VALUES ('Load ${id} failed: %{public}s!', 'load|failed', 'load value failed value'), ('done', 'done', 'done'), ('{user.name} left %d', 'left', 'value left value')) v(t, segments, skeleton)")
def _(s, d):
    templates = s.createDataFrame([("Load ${id} failed: %{public}s!",), ("done",), ("{user.name} left %d",)], "t string")
    return templates.select("t", F.array_join(T.literal_segments(F.col("t")), "|").alias("segments"), T.canonical(F.regexp_replace("t", T.PLACEHOLDER, " <value> ")).alias("skeleton"))


@query("fn13_template_fingerprint", r"SELECT p_partkey, sha256(concat_ws('|', 'error', 'store', trim(regexp_replace(lower(p_name || ' value failed'), '[^\p{L}\p{N}_]+', ' ', 'g')), p_brand))[:16] AS fingerprint FROM part")
def _(s, d):
    template = F.concat("p_name", F.lit(" ${value} failed"))
    return table(s, d, "part").select("p_partkey", T.template_fingerprint(F.lit("ERROR"), F.lit("Store"), template, F.col("p_brand")).alias("fingerprint"))


@query("fn19_layers", f"""SELECT page_id, CASE WHEN contains(lower(path), 'test') OR contains(lower(path), 'spec') THEN 'test' WHEN regexp_matches(lower(path), '\\.(json|json5|yaml|yml|toml)$') OR contains(lower(path), 'config') THEN 'config'
    WHEN contains(lower(path), 'page') OR contains(lower(path), 'view') THEN 'ui' WHEN contains(lower(path), '/data/') OR contains(lower(path), 'storage') THEN 'data' WHEN contains(lower(path), 'service') THEN 'service' ELSE 'core' END AS layer FROM {PATHS_SQL}""")
def _(s, d):
    return views.paths(s, d).select("page_id", T.layer(F.col("path")).alias("layer"))


@query("fn21_artifact_roles", f"SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'test' ELSE 'production' END AS role, 'item' || page_id % 7 AS family FROM {PATHS_SQL}")
def _(s, d):
    return views.paths(s, d).select("page_id", T.artifact_role(F.col("path")).alias("role"), T.artifact_family(F.col("path")).alias("family"))


@query("rk37_role_competition", f"SELECT family, count(*) AS files, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT CASE WHEN page_id % 5 = 1 THEN 'test' ELSE 'production' END AS role, 'item' || page_id % 7 AS family FROM {PATHS_SQL}) GROUP BY family HAVING count(DISTINCT role) > 1")
def _(s, d):
    files = views.paths(s, d).select(T.artifact_role(F.col("path")).alias("role"), T.artifact_family(F.col("path")).alias("family"))
    return files.groupBy("family").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles")).where("roles like '%,%'")


@query("fn31_intent", f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'runtime_log_diagnosis' WHEN 'click' THEN 'code_location' WHEN 'view' THEN 'memory_maintenance' ELSE 'general_context' END AS intent FROM events""")
def _(s, d):
    asked = F.expr("CASE event_type WHEN 'error' THEN 'why has this Failed' WHEN 'click' THEN 'where is the function' WHEN 'view' THEN 'refresh stale notes' ELSE 'hello' END")
    return table(s, d, "events").select("event_id", T.intent(asked).alias("intent"))


@query("fn32_goal", "SELECT event_id, CASE event_type WHEN 'error' THEN 'diagnosis' WHEN 'click' THEN 'change_impact' WHEN 'view' THEN 'governance' ELSE 'code_understanding' END AS goal FROM events")
def _(s, d):
    asked = F.expr("CASE event_type WHEN 'error' THEN 'debug the error after a change' WHEN 'click' THEN 'impact of this change' WHEN 'view' THEN 'stale notes' ELSE 'what is this' END")
    return table(s, d, "events").select("event_id", T.goal(asked).alias("goal"))


@query("fn14_log_lines", f"""SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' ELSE CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'info' WHEN 'view' THEN 'debug' WHEN 'purchase' THEN 'warning' ELSE 'info' END END AS level,
    CASE event_id % 4 WHEN 3 THEN 'kernel' ELSE 'Store' END AS logger, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%H:%M:%S') WHEN 1 THEN 'app.main' WHEN 2 THEN 'com.app:ui' ELSE '' END AS process, substr(line, instr(line, CASE event_id % 4 WHEN 3 THEN 'kernel: ' ELSE 'Store: ' END) + CASE event_id % 4 WHEN 3 THEN 8 ELSE 7 END) AS message FROM {LINES_SQL}""")
def _(s, d):
    return logs.parsed(views.lines(s, d)).select("event_id", "level", "logger", "process", "message")


@query("fn15_key_values", f"SELECT event_id, CASE event_type WHEN 'error' THEN 'error_code=E' || user_id || ',reason=timeout,request_id=' || event_id WHEN 'click' THEN 'route=pages/' || user_id % 7 || ',session_id=' || user_id WHEN 'purchase' THEN 'duration_ms=' || event_id % 90 || ',result=success' ELSE '' END AS fields FROM events")
def _(s, d):
    entries = F.array_sort(F.transform(F.map_entries(T.key_values(F.col("line"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return views.lines(s, d).select("event_id", F.array_join(entries, ",").alias("fields"))


@query("fn16_event_types", "SELECT event_id, CASE event_type WHEN 'error' THEN 'profile_load_failed' WHEN 'click' THEN 'route_navigation' WHEN 'view' THEN 'network_request' WHEN 'signup' THEN 'session_invalid' ELSE 'generic_runtime_event' END AS kind FROM events")
def _(s, d):
    return logs.parsed(views.lines(s, d)).select("event_id", "kind")


@query("fn24_canonical_digest", "SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\"}') AS digest FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.digest_of({"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("digest"))


@query("ag28_log_signals", f"""WITH e AS (SELECT event_id % 4 AS form, event_type FROM events), s AS (SELECT
    CASE WHEN form <> 3 THEN 0.07 + 0.06 ELSE 0 END + CASE WHEN form <> 3 THEN 0.06 ELSE 0 END + 0.06
    + CASE event_type WHEN 'purchase' THEN 0.08 WHEN 'error' THEN 0.07 + 0.08 + 0.08 + 0.08 + 0.08 + 0.12 + 0.07 + 0.08 WHEN 'click' THEN 0.07 + 0.08 + 0.10 + 0.12 + 0.07 WHEN 'view' THEN 0.07 + 0.08 + 0.10 + 0.07 ELSE 0.07 + 0.08 END
    + CASE WHEN event_type = 'purchase' THEN 0.08 ELSE 0 END AS score FROM e)
    SELECT CASE WHEN floor(score * 1000 + 0.5) / 1000 >= 0.75 THEN 'good' WHEN floor(score * 1000 + 0.5) / 1000 >= 0.55 THEN 'watch' ELSE 'poor' END AS band, count(*) AS events, round(CAST(avg(floor(score * 1000 + 0.5) / 1000) AS DOUBLE), 6) AS mean FROM s GROUP BY 1""")
def _(s, d):
    scored = scoring.log_signal(logs.parsed(views.lines(s, d)))
    return scored.groupBy(F.col("signal_band").alias("band")).agg(F.count("*").alias("events"), F.round(F.avg("signal_score"), 6).alias("mean"))


@query("ql08_missing_signals", """SELECT signal, count(*) AS n FROM (SELECT 'neighbor_context' AS signal FROM events UNION ALL SELECT 'timestamp' FROM events WHERE event_id % 4 = 3 UNION ALL SELECT 'level' FROM events WHERE event_id % 4 = 3
    UNION ALL SELECT 'process' FROM events WHERE event_id % 4 = 3 UNION ALL SELECT 'event_type' FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'reason' FROM events WHERE event_type <> 'error'
    UNION ALL SELECT 'error_code' FROM events WHERE event_type <> 'error' UNION ALL SELECT 'request_or_session_id' FROM events WHERE event_type NOT IN ('error', 'click')) GROUP BY signal""")
def _(s, d):
    scored = scoring.log_signal(logs.parsed(views.lines(s, d))).select(F.explode(F.split("missing", ",")).alias("signal"))
    told = ["neighbor_context", "timestamp", "level", "process", "event_type", "reason", "error_code", "request_or_session_id"]
    return scored.where(F.col("signal").isin(*told)).groupBy("signal").agg(F.count("*").alias("n"))



# --- an index that follows its table ---------------------------------------------------------------------------------

_KEPT = "p_partkey % 5 <> 0"
#: What changes the index: some parts come, some get another name (twice, the later one counts), some go.
_CHANGE = "CASE WHEN p_partkey % 11 = 0 THEN 'delete' WHEN p_partkey % 5 = 0 THEN 'insert' WHEN p_partkey % 7 = 0 THEN 'update' END"
_AFTER = "concat('fresh ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' again' ELSE '' END)"
_NOW_SQL = f"""now AS (SELECT p_partkey AS id, p_type, p_brand, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 5 <> 0 THEN {_AFTER} ELSE p_name END AS p_name FROM part WHERE p_partkey % 11 <> 0),
    t AS (SELECT id, 'file_path' AS field, unnest({sql_tokens('p_type')}) AS term FROM now UNION ALL SELECT id, 'symbol', unnest({sql_tokens('p_brand')}) FROM now UNION ALL SELECT id, 'identity_terms', unnest({sql_tokens('p_name')}) FROM now),
    dl AS (SELECT id, count(*) AS doc_len FROM t GROUP BY id), n AS (SELECT (SELECT count(*) FROM now) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM now) AS mean_len)"""
_FOLLOWED: dict[tuple[str, str], tuple[str, list[upkeep.Generation]]] = {}


def followed(s: SparkSession, d: str) -> tuple[str, list[upkeep.Generation]]:
    """An index of some parts, changed by two batches and merged: its folder and its generations. Made once a session and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _FOLLOWED:
        path = f"{graph.shared_folder(s)}/followed-{uuid.uuid4().hex}"
        parts, fields = table(s, d, "part"), list(FIELDS["part"])
        told = [f"{v} AS {k}" for k, v in FIELDS["part"].items()]
        first = upkeep.rebuild(parts.where(_KEPT).selectExpr("p_partkey AS id", *told), fields, path, "one")
        change = parts.selectExpr("*", f"{_CHANGE} AS op").where("op is not null")
        early = change.where("op = 'update'").selectExpr("p_partkey AS id", "op", "1L AS sequence", *(x.replace("p_name", "'stale words'") for x in told))
        late = change.selectExpr("p_partkey AS id", "op", "2L AS sequence", *(x.replace("p_name", f"CASE op WHEN 'update' THEN {_AFTER} ELSE p_name END") for x in told))
        batch = early.unionByName(late)
        second = upkeep.apply(batch.where("id % 2 = 0"), path, "two")
        third = upkeep.apply(batch.where("id % 2 = 1"), path, "three")
        _FOLLOWED[key] = path, [first, second, third, upkeep.merge(s, path)]
    return _FOLLOWED[key]


_SEARCH = ["fresh", "red", "again"]
_WEIGHTS = {"file_path": 1.0, "symbol": 2.0, "identity_terms": 9.0}


@query("rk02_changed_index", f"WITH {_NOW_SQL}, {sql_bm25('part', _SEARCH, _WEIGHTS, 100)} SELECT id, score, terms FROM r")
def _(s, d):
    path, generations = followed(s, d)
    index_now = upkeep.opened(s, path, generations[2])  # three segments with tombstones
    return index.bm25(index_now.postings, index_now.statistics(), _SEARCH, _WEIGHTS, 100)


@query("rk03_merged_index", f"WITH {_NOW_SQL} SELECT id, field, term, count(*) AS tf, max(doc_len) AS doc_len FROM t JOIN dl USING (id) GROUP BY id, field, term")
def _(s, d):
    path, generations = followed(s, d)
    return upkeep.opened(s, path, generations[3]).postings.select("id", "field", "term", "tf", "doc_len")


@query("st04_generations", f"""WITH c AS (SELECT p_partkey AS id, {_CHANGE} AS op, {_KEPT} AS had FROM part),
    k AS (SELECT *, op = 'delete' AND had AS lost, op = 'insert' AS came, op IS NOT NULL AND had AS retires FROM c)
    SELECT 1 AS generation, 1 AS segments, 'one' AS source_revision, count(*) FILTER (had) AS indexed, 0 AS retired, count(*) FILTER (had) AS seen FROM k
    UNION ALL SELECT 2, 2, 'two', count(*) FILTER (had) - count(*) FILTER (lost AND id % 2 = 0) + count(*) FILTER (came AND id % 2 = 0), count(*) FILTER (retires AND id % 2 = 0),
        count(*) FILTER (had) - count(*) FILTER (lost AND id % 2 = 0) + count(*) FILTER (came AND id % 2 = 0) FROM k
    UNION ALL SELECT 3, 3, 'three', count(*) FILTER (had) - count(*) FILTER (lost) + count(*) FILTER (came), count(*) FILTER (retires AND id % 2 = 1), count(*) FILTER (had) - count(*) FILTER (lost) + count(*) FILTER (came) FROM k
    UNION ALL SELECT 4, 1, 'three', count(*) FILTER (had) - count(*) FILTER (lost) + count(*) FILTER (came), 0, count(*) FILTER (had) - count(*) FILTER (lost) + count(*) FILTER (came) FROM k""")
def _(s, d):
    path, generations = followed(s, d)
    seen = [upkeep.opened(s, path, g).lengths.select(F.lit(g.generation).alias("generation")) for g in generations]
    counts = reduce(DataFrame.unionByName, seen).groupBy("generation").agg(F.count("*").alias("seen"))
    told = s.createDataFrame([(g.generation, len(g.segments), g.source_revision, g.indexed, g.retired) for g in generations], "generation long, segments long, source_revision string, indexed long, retired long")
    return told.join(counts, "generation", "left")
