"""Which of the rows that a request recalled stay in focus: the first of eleven rules that finds any.

All requests go through in one pass. A rule is a flag on rows, computed over the rows of a request by windows; the least rule with
a flagged row is the request's, and its flagged rows stay. Items: (request, position, id, file_path, symbol, summary, score,
reasons, lanes, method_coverage, behaviour_coverage); position orders a request's rows, from 1. What a request has is bounded
by recall, and so is the list that the cover of behaviours is folded over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from .localize import described

#: Reasons and thresholds. Fixed values.
IDENTITY = ("exact_symbol", "exact_file_path", "exact_identifier")
STRONG = (*IDENTITY, "exact_path_segment")
FLOW = ("graph_relation:passes_property", "graph_relation:renders_component")
COMPETING = ("exact_symbol", "multi_concept_coverage", "structural_behavior", *FLOW)
CONTRACTS = ("persistenceread", "platformsensitiveui", "uicallbackbinding")
NAMED = r"\b[A-Z][A-Za-z0-9_$]*(?:Ability|Controller|Model|Page|Record|Repository|Service|View|ViewModel)\b"
MEMBER = r"\b[a-z][A-Za-z0-9_$]*[A-Z][A-Za-z0-9_$]*\b"
NEAR, RIVAL, PART, APART, LEAST, TWICE = 0.85, 0.85, 0.75, 0.65, 12.0, 2.0
RULES = ("named", "callers", "contracts", "behaviour", "method", "structural", "operation", "explicit_method", "shared_owner", "identity", "flow", "none")

def _all() -> WindowSpec:
    """All rows of a request (made when called: modules are imported before there is a session)."""
    return Window.partitionBy("request")


def _has(*reasons: str) -> Column:
    return F.arrays_overlap("reasons", F.array(*map(F.lit, reasons)))


def _paths(flag: Column) -> Column:
    """How many paths the flagged rows of a request have."""
    return F.size(F.collect_set(F.when(flag & (F.coalesce("file_path", F.lit("")) != ""), F.col("file_path"))).over(_all()))


def _first_paths(rows: DataFrame, flag: str, most: int) -> DataFrame:
    """Flagged rows of the first `most` paths that flagged rows have."""
    first = F.min(F.when(F.col(flag), F.col("position"))).over(Window.partitionBy("request", "file_path"))
    rows = rows.withColumn("__first", first)
    place = F.dense_rank().over(Window.partitionBy("request", flag).orderBy("__first"))
    return rows.withColumn(flag, F.col(flag) & (place <= most)).drop("__first")


def covering(rows: DataFrame, most: int = 3) -> DataFrame:
    """(request, chosen): positions of the rows (request, position, markers) that a greedy cover of markers takes, those with
    most markers first; a row that adds none is passed over."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.size("markers")).alias("n"), "position", "markers")))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("chosen"))

    def step(a: Column, x: Column) -> Column:
        more = (F.size(a["chosen"]) < most) & (F.size(F.array_except(x["markers"], a["seen"])) > 0)
        return F.when(more, F.struct(F.array_union(a["seen"], x["markers"]).alias("seen"), F.concat(a["chosen"], F.array(x["position"])).alias("chosen"))).otherwise(a)

    return rows.groupBy("request").agg(F.aggregate(ranked, start, step)["chosen"].alias("chosen"))


def focus(items: DataFrame, requests: DataFrame) -> DataFrame:
    """The items of each request that stay in focus, with the rule that chose them; with no rule all stay (`none`).

    - named: the request names two types or more, and rows of two paths or more have these names;
    - callers, operation: rows found as such;
    - contracts: behaviours of owners that the request describes; the rows with most of them and a score near the best, two paths;
    - behaviour: two behaviours or more asked for; rows with most of them, two paths;
    - method: rows whose method bodies have three terms or more, three paths, unless a row elsewhere rivals their best score;
    - structural: rows that together cover the behaviours, three at most;
    - explicit_method: the one row that a member's name and body tell, if its score is twice that of all others;
    - shared_owner: "shared" in the request, and a first row that leads;
    - identity: strong identities on two paths or more, where nothing flows;
    - flow: rows along the flow of components, with identities or else the first other row.
    """
    asked = described(requests).select("request", "query", F.array_distinct(F.regexp_extract_all("query", F.lit(NAMED), F.lit(0))).alias("__names"), F.col("behaviours").alias("__markers"), F.col("targets").alias("__roles"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = items.join(asked, "request").withColumns({"score": F.coalesce("score", F.lit(0.0)), "reasons": F.coalesce("reasons", F.array().cast("array<string>"))})
    stem = F.regexp_replace(F.regexp_extract(text("file_path"), r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    rows = rows.withColumns({"__in_summary": F.array_intersect("__markers", T.tokens(text("summary"))), "__told": F.array_intersect("__markers", T.tokens(F.concat_ws(" ", text("file_path"), text("summary"))))})
    contracts = F.array_intersect("__in_summary", F.array(*map(F.lit, CONTRACTS)))
    rows = rows.withColumns({
        "__named": (F.size("__names") >= 2) & (F.array_contains("__names", stem) | F.array_contains("__names", text("symbol"))),
        "__contracts": F.size(contracts), "__behaviours": F.coalesce("behaviour_coverage", F.lit(0)), "__methods": F.coalesce("method_coverage", F.lit(0)),
        "__structural": _has("structural_behavior") & (F.size("__told") > 0), "__flow": _has(*FLOW), "__identity": _has(*IDENTITY), "__strong": _has(*STRONG),
        "__role": _has("exact_path_segment") & F.arrays_overlap("__roles", T.path_terms(text("file_path"))),
    })
    flag = lambda c: F.coalesce(c, F.lit(False))
    best = lambda c, value="score": F.max(F.when(c, F.col(value))).over(_all())
    first = lambda value: F.max(F.when(F.col("position") == 1, value)).over(_all())
    rows = rows.withColumns({
        "f0": flag(F.col("__named") & (_paths(F.col("__named")) >= 2)), "f1": _has("caller_owner"), "f6": _has("exact_behavior_operation"),
        "__c": (F.col("__contracts") > 0) & (F.col("__contracts") == F.max("__contracts").over(_all())),
        "f3": (F.size("__markers") >= 2) & (F.col("__behaviours") >= 2) & (F.col("__behaviours") == F.max("__behaviours").over(_all())) & _has("semantic_behavior"),
        "__m": (F.col("__methods") >= 3) & _has("multi_term_method_evidence"),
        "__e": F.col("query").rlike(MEMBER) & (F.col("__methods") >= 2) & F.array_contains(F.coalesce("lanes", F.array().cast("array<string>")), "method_body_fts") & _has("exact_path_segment"),
        "f9": F.col("__strong") & (_paths(F.col("__strong")) >= 2) & ~F.max("__flow").over(_all()),
        "__lead": first(F.col("score")), "__second": F.max(F.when(F.col("position") == 2, F.col("score"))).over(_all()), "__leads": flag(first(_has("multi_concept_coverage"))),
    })
    rows = rows.withColumns({
        "f2": flag(F.col("__c") & (F.col("score") >= best(F.col("__c")) * NEAR)),
        "__top": best(F.col("__m")), "__inside": F.max(F.col("__m").cast("int")).over(Window.partitionBy("request", "file_path")) == 1,
        "__owner": F.col("__e") & (F.row_number().over(Window.partitionBy("request", "__e").orderBy(F.desc("score"), "position")) == 1),
        "f8": flag(F.lower("query").contains("shared") & F.col("__leads") & (F.col("__lead") > 0) & F.col("__second").isNotNull() & (F.col("__second") <= F.col("__lead") * APART) & _has("multi_concept_coverage") & (F.col("score") >= F.col("__lead") * PART)),
        "__other": F.first(F.when(~F.col("__flow"), F.col("position")), ignorenulls=True).over(_all().orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    hard = F.col("__role") | _has(*(r for r in COMPETING if r != "structural_behavior"))
    rivals = ~F.col("__inside") & F.when(hard, F.col("score") >= F.col("__top") * RIVAL).otherwise(_has("structural_behavior") & (F.col("score") >= F.greatest(F.lit(LEAST), F.col("__top") * RIVAL)))
    rival = best(~F.col("__owner") & ~_has("graph_neighbor"))
    both = _paths(F.col("__identity")) >= 2
    rows = rows.withColumns({
        "f4": flag(F.col("__m") & (F.col("score") >= F.col("__top") * PART) & ~F.coalesce(F.max(rivals).over(_all()), F.lit(False))),
        "f7": flag(F.col("__owner") & (F.col("score") >= F.greatest(F.lit(LEAST), F.coalesce(rival, F.lit(0.0)) * TWICE))),
        "f10": flag(F.max("__flow").over(_all()) & F.when(both, F.col("__flow") | F.col("__identity")).otherwise((_paths(F.col("__flow")) >= 2) & (F.col("__flow") | (F.col("position") == F.col("__other"))))),
    })
    for name, most in (("f2", 2), ("f3", 2), ("f4", 3)):
        rows = _first_paths(rows, name, most)
    cover = covering(rows.where("__structural").select("request", F.col("position").cast("int").alias("position"), F.col("__told").alias("markers")))
    rows = rows.join(cover, "request", "left").withColumn("f5", F.coalesce(F.array_contains("chosen", F.col("position").cast("int")), F.lit(False)))
    least = F.coalesce(*(F.when(F.max(f"f{i}").over(_all()), i) for i in range(11)), F.lit(11))
    rows = rows.withColumn("__rule", least)
    stays = F.when(F.col("__rule") == 11, True).otherwise(F.element_at(F.array(*(F.col(f"f{i}") for i in range(11)), F.lit(True)), F.col("__rule") + 1))
    rule = F.element_at(F.array(*map(F.lit, RULES)), F.col("__rule") + 1).alias("rule")
    return rows.where(stays).select(*items.columns, rule)
