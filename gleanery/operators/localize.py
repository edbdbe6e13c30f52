"""Callable localisation for many requests at once: files, their callables, seeds, owners, chosen callables, source ranges.

Every stage is a window over the rows of a request, bounded by the limits below, and feeds the next one. Tables:

- requests (request, query, plain): plain says that nothing of the query is excluded;
- hits (request, kind, id, file_path, score, rank, exact, coverage): what recall found, `file` and `symbol` rows; exact
  says that path or symbol is named by the request, coverage how many behaviour words the row has;
- symbols (id, file_path, symbol, symbol_type, start_line, end_line, owner_name, owner_kind, FIELDS, mechanisms), where
  mechanisms is a list of (line, kind, terms);
- edges (source, target, relation, confidence) between symbols, flows (source_path, target, relation, confidence) from
  files to components; both those that hold at present.

Rows without id or path are not candidates; null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import sent, written
from .tables import top_per_group

#: Limits of the stages, and weights of a callable's fields. Fixed values.
FILES, POOL, DIRECT, SEEDS, OWNERS, CALLABLES, RANGES = 8, 128, 32, 6, 16, 12, 8
PER_FOLDER, PER_FILE, RESERVED, AROUND = 2, 2, 3, 2
FIELDS = {"symbol": 4.0, "business_terms": 4.0, "business_summary": 3.0, "summary": 1.5, "method_evidence": 2.0, "string_evidence": 2.5}
EXACT, DIRECT_SHARE, DIRECT_MOST, MECHANISM, MECHANISM_MOST, KIND, OWNER, LOCATABLE = 12.0, 0.18, 9.0, 3.0, 9.0, 6.0, 3.0, 0.5
PRIOR_MOST, PRIOR_HALF = 12.0, 10.0
CALLABLE_TYPES, TYPE_KINDS = ("function", "method"), ("class", "component", "enum", "interface", "object", "struct")
OWNER_RELATIONS = ("calls", "awaits", "registers_callback", "renders_component", "passes_property")
FLOW_RELATIONS = ("renders_component", "passes_property")


def _place(partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def described(requests: DataFrame) -> DataFrame:
    """Requests with what their words tell: terms, behaviours, the kinds of owner asked for, and whether tests are meant.

    Each is a column that the stages read, so a request's text is looked at once.
    """
    if "terms" in requests.columns:
        return requests
    query = F.col("query")
    rows = requests.withColumn("terms", T.query_tokens(query))
    return rows.withColumns({"behaviours": T.behaviours(query, F.col("terms")), "kinds": T.requested_kinds(query), "targets": T.target_kinds(query), "intent": T.artifact_intent(F.col("terms"))})


# --- files ----------------------------------------------------------------------------------------------------------


def file_candidates(hits: DataFrame, symbols: DataFrame, requests: DataFrame, most: int = FILES) -> DataFrame:
    """(request, file_path, file_rank, score, coverage): at most so many files of a request, PER_FOLDER of a folder.

    Up to RESERVED files come first for a type that the request names (whatever their folder holds), and, if the request
    has behaviour words, for a named path or symbol and for the most behaviour words. Places that folders leave free are
    filled in order.
    """
    types = symbols.where(F.col("symbol_type").isin(*TYPE_KINDS)).join(sent(hits.select("id").distinct()), "id", "left_semi")
    types = written(types.select("id", F.lit(True).alias("__type")))
    told = hits.where(F.col("kind").isin("file", "symbol") & (F.coalesce("file_path", F.lit("")) != "")).join(types, "id", "left")
    defined = (F.col("kind") == "symbol") & F.col("exact") & F.coalesce("__type", F.lit(False))
    files = told.groupBy("request", "file_path").agg(
        F.greatest(F.lit(0.0), F.max("score")).alias("score"), F.min("rank").alias("first"), F.greatest(F.lit(0), F.max("coverage")).alias("coverage"), F.max(defined).alias("defined"), F.max("exact").alias("exact")
    )
    files = files.join(described(requests).select("request", (F.size("behaviours") > 0).alias("behaves")), "request")
    best = [F.desc("score"), F.asc("first"), F.asc("file_path")]
    place = lambda flag, *order: F.when(flag, _place(["request", flag], *order))
    files = files.withColumns({"__named": F.col("exact") & F.col("behaves"), "__covered": (F.col("coverage") > 0) & F.col("behaves")})
    files = files.withColumns({"__order": _place(["request"], *best), "__a": place(F.col("defined"), *best), "__b": place(F.col("__named"), *best), "__c": place(F.col("__covered"), F.desc("coverage"), *best)})
    kept = lambda c: F.col(c) <= RESERVED
    turn = F.when(kept("__a"), F.col("__a")).when(kept("__b"), F.col("__b") + RESERVED).when(kept("__c"), F.col("__c") + 2 * RESERVED).otherwise(F.col("__order") + 3 * RESERVED)
    files = files.withColumns({"__turn": turn, "__folder": _folder(F.col("file_path")), "__safe": F.coalesce(kept("__a"), F.lit(False))})
    later = (_place(["request", "__folder"], F.col("__turn")) > PER_FOLDER) & ~F.col("__safe")
    chosen = top_per_group(files.withColumn("__later", later), ["request"], [F.col("__later"), F.col("__turn")], most)
    return chosen.select("request", "file_path", _place(["request"], *best).alias("file_rank"), "score", "coverage")


# --- pool -----------------------------------------------------------------------------------------------------------


def callable_pool(files: DataFrame, symbols: DataFrame, hits: DataFrame, most: int = POOL) -> DataFrame:
    """The callables of the files of a request: those found themselves, and one of each stretch of a file, POOL at most.

    Adds file_rank, coverage and direct (the score of the row's own hit). Places within files do not depend on requests
    and are counted once.
    """
    own = Window.partitionBy("file_path")
    symbols = symbols.join(sent(files.select("file_path").distinct()), "file_path", "left_semi")
    placed = symbols.where(F.col("symbol_type").isin(*CALLABLE_TYPES)).withColumns({"__rank": F.row_number().over(own.orderBy("start_line", "id")), "__count": F.count("*").over(own)})
    found = hits.where("kind = 'symbol' and id > 0").join(files.select("request", "file_path"), ["request", "file_path"], "left_semi")
    found = found.groupBy("request", "id").agg(F.max_by("score", "rank").alias("direct"), F.min("rank").alias("rank"), F.max("exact").alias("exact"))
    found = found.withColumn("__preferred", F.when(_place(["request"], F.col("rank")) <= DIRECT, 0).otherwise(1)).drop("rank")
    share = F.ceil(F.lit(most) / F.count("*").over(Window.partitionBy("request"))).cast("int")
    rows = files.withColumn("__share", share).drop("score").join(placed, "file_path").join(found, ["request", "id"], "left")
    rows = rows.withColumns({"__preferred": F.coalesce("__preferred", F.lit(1)), "direct": F.coalesce("direct", F.lit(0.0)), "exact": F.coalesce("exact", F.lit(False))})
    stretch = F.least(F.col("__share") - 1, F.floor((F.col("__rank") - 1) * F.col("__share") / F.col("__count")))
    rows = rows.withColumn("__stretch", stretch)
    rows = rows.withColumn("__nth", _place(["request", "file_path", "__stretch"], F.col("__preferred"), F.col("__rank"), F.col("id")))
    rows = rows.where("__preferred = 0 or __nth = 1")
    rows = rows.withColumn("__pool", _place(["request", "file_path"], F.col("__preferred"), F.col("__nth"), F.col("__rank"), F.col("id"))).where("__pool <= __share")
    rows = top_per_group(rows, ["request"], [F.col("__pool"), F.col("file_path"), F.col("start_line"), F.col("id")], most)
    return rows.drop("__share", "__rank", "__count", "__preferred", "__stretch", "__nth", "__pool")


# --- ranks ----------------------------------------------------------------------------------------------------------


def prior(rank: Column, plain: Column) -> Column:
    """What the place of its file gives a callable: steps of one for plain requests, else a share that falls off slowly."""
    near = rank.between(1, FILES)
    return F.when(plain, F.when(near, FILES + 1.0 - rank).otherwise(0.0)).otherwise(F.when(near, F.round(PRIOR_MOST * (PRIOR_HALF + 1) / (PRIOR_HALF + rank), 3)).otherwise(0.0))


def matched_mechanisms(mechanisms: Column, terms: Column) -> Column:
    """The mechanisms that a request's terms name, with how many terms do; most first, then by line and kind."""
    names = lambda m: F.array_distinct(F.concat(F.array(m["kind"], F.replace(m["kind"], F.lit("_"), F.lit(""))), F.transform(F.coalesce(m["terms"], F.array().cast("array<string>")), F.lower)))
    told = F.transform(mechanisms, lambda m: F.struct((-F.size(F.array_intersect(names(m), terms))).alias("hits"), m["line"].alias("line"), m["kind"].alias("kind")))
    return F.coalesce(F.array_sort(F.filter(told, lambda m: m["hits"] < 0)), F.array().cast("array<struct<hits:int,line:int,kind:string>>"))


def rank_callables(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Callables of requests with localization_score, evidence_score and what led to them; `place` is the rank.

    Where a request's rows hold a test and the production code of one name, the best row of the kind that the request
    asks for stands for the highest score of both, and rows of other kinds go behind all others.
    """
    asked = described(requests).select("request", "query", "plain", F.col("terms").alias("__terms"), F.col("behaviours").alias("__behaviours"), F.col("kinds").alias("__kinds"), F.col("targets").alias("__targets"), F.col("intent").alias("__intent"))
    rows = top_per_group(rows, ["request", "id"], [F.col("graph_depth")], 1).join(asked, "request")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    hits = lambda c: F.size(F.filter("__terms", lambda t: T.token_matches(t, low(c))))
    whole = F.lower(F.trim("query"))
    named = (low("symbol") != "") & (whole != "") & (whole.contains(low("symbol")) | low("symbol").contains(whole))
    lexical = reduce(lambda x, y: x + y, (hits(c) * w for c, w in FIELDS.items()), F.when(named, EXACT).otherwise(0.0))
    rows = rows.withColumns({
        "exact_symbol": named | F.col("exact"),
        "mechanism_hits": matched_mechanisms(F.col("mechanisms"), F.array_distinct(F.concat("__terms", "__behaviours"))),
        "kind_match": F.array_contains("__kinds", F.coalesce("owner_kind", F.lit(""))), "target_match": F.array_contains("__targets", F.coalesce("owner_kind", F.lit(""))),
        "owner_named": T.owner_named(F.col("query"), F.col("owner_name")), "__prior": prior(F.col("file_rank"), F.col("plain")), "__lexical": lexical,
    })
    direct = F.when(F.col("plain"), F.least(F.lit(DIRECT_MOST), F.col("direct") * DIRECT_SHARE)).otherwise(0.0)
    mechanism = F.when(F.size("mechanism_hits") > 0, F.least(F.lit(MECHANISM_MOST), MECHANISM * -F.element_at("mechanism_hits", 1)["hits"])).otherwise(0.0)
    graph = F.when(F.col("graph_depth") > 0, OWNER + OWNER * F.coalesce("graph_confidence", F.lit(0.0))).otherwise(0.0)
    locatable = F.when((F.coalesce("start_line", F.lit(0)) != 0) & (F.coalesce("end_line", F.lit(0)) != 0), LOCATABLE).otherwise(0.0)
    score = F.col("__lexical") + direct + F.col("__prior") + mechanism + F.when(F.col("kind_match"), KIND).otherwise(0.0) + graph + locatable
    rows = rows.withColumns({"localization_score": F.round(score, 3), "evidence_score": F.round(F.when(F.col("plain"), score).otherwise(score - F.col("__prior")), 3)})
    rows = rows.withColumns({"role": T.artifact_role(F.col("file_path")), "__family": T.artifact_family(F.col("file_path"))})
    family = Window.partitionBy("request", "__family")
    both = (F.col("__family") != "") & (F.max(F.col("role") == "production").over(family)) & (F.max(F.col("role") == "test").over(family))
    rows = rows.withColumns({"role_competition": both, "__top": F.max("localization_score").over(family)})
    wanted = F.when(F.col("__intent") == "implementation", "production").when(F.col("__intent") == "validation", "test")
    fits = F.coalesce(F.col("role_competition") & (F.col("role") == wanted), F.lit(False))
    rows = rows.withColumn("__fits", fits)
    first = F.row_number().over(Window.partitionBy("request", "__family", "__fits").orderBy(F.desc("localization_score"), "file_path", "start_line", "id"))
    rows = rows.withColumns({"representative": F.col("__fits") & (first == 1), "shadow": F.col("role_competition") & wanted.isNotNull() & ~F.col("__fits")})
    rank = F.when(F.col("representative"), F.col("__top")).otherwise(F.col("localization_score"))
    order = [F.col("shadow"), F.desc("owner_named"), F.desc("target_match"), F.desc(rank), F.desc("representative"), F.col("graph_depth"), F.col("file_path"), F.col("start_line"), F.col("id")]
    return rows.withColumn("place", _place(["request"], *order)).drop("query", "plain", "__terms", "__behaviours", "__kinds", "__targets", "__intent", "__lexical", "__prior", "__family", "__fits", "__top")


# --- seeds and owners -----------------------------------------------------------------------------------------------


def graph_seeds(ranked: DataFrame, most: int = SEEDS) -> DataFrame:
    """The callables from which the graph is asked: those with evidence of their own first, then by rank."""
    told = (F.col("direct") > 0) | (F.size("mechanism_hits") > 0) | F.col("exact_symbol")
    evidence = F.struct(-F.col("direct"), ~F.col("exact_symbol"), -F.size("mechanism_hits"), -F.col("localization_score"), F.col("id"))
    order = [F.desc(told), F.when(told, evidence), F.col("place")]
    return top_per_group(ranked.where("id > 0"), ["request"], order, most).select("request", "id", "file_path", _place(["request"], *order).alias("seed"))


def owners(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, flows: DataFrame, most: int = OWNERS) -> DataFrame:
    """Callables one edge before a seed, and, where these leave room, the first callable of files that show a component of
    a seed's file (its build method before others)."""
    callables = symbols.where(F.col("symbol_type").isin(*CALLABLE_TYPES))
    relations = F.array_sort(F.collect_set("relation")).alias("graph_relations")
    links = edges.where(F.col("relation").isin(*OWNER_RELATIONS)).join(sent(seeds.select("request", F.col("id").alias("target"))), "target")
    before = written(links.groupBy("request", F.col("source").alias("id")).agg(F.max("confidence").alias("graph_confidence"), relations))
    direct = sent(before).join(callables, "id").withColumn("__flow", F.lit(0))
    parts = symbols.where("symbol_type = 'component'").select(F.col("id").alias("target"), "file_path").join(sent(seeds.select("request", "file_path").distinct()), "file_path").select("request", "target")
    shown = flows.where(F.col("relation").isin(*FLOW_RELATIONS)).join(sent(written(parts)), "target").groupBy("request", F.col("source_path").alias("file_path"))
    shown = written(shown.agg(F.max("confidence").alias("graph_confidence"), relations))
    first = top_per_group(callables.join(sent(shown.select("file_path").distinct()), "file_path", "left_semi"), ["file_path"], [F.when(F.col("symbol") == "build", 0).otherwise(1), F.col("start_line"), F.col("id")], 1)
    flow = shown.join(first, "file_path").withColumn("__flow", F.lit(1))
    order = [F.col("__flow"), F.desc("graph_confidence"), F.col("id")]
    # The limit counts what each kind offers; a callable that both offer takes its place among the edges.
    offered = top_per_group(direct.unionByName(flow), ["request"], order, most)
    return top_per_group(offered, ["request", "id"], [F.col("__flow")], 1).drop("__flow")


# --- choice ---------------------------------------------------------------------------------------------------------


def diverse_callables(ranked: DataFrame, most: int = CALLABLES) -> DataFrame:
    """The first callables by rank, PER_FILE of a file; free places are filled in order. `choice` is the new place."""
    later = F.row_number().over(Window.partitionBy("request", "file_path").orderBy("place")) > PER_FILE
    chosen = ranked.withColumn("__later", later).withColumn("choice", _place(["request"], F.col("__later"), F.col("place")))
    return chosen.where(F.col("choice") <= most).drop("__later")


def source_ranges(chosen: DataFrame, most: int = RANGES) -> DataFrame:
    """(request, id, file_path, symbol, choice, start_line, end_line, reason): AROUND lines on both sides of the mechanism
    that a request names, within the callable, or else the whole callable; the first ones that have lines."""
    hit = F.try_element_at("mechanism_hits", F.lit(1))
    line = F.least(F.col("end_line"), F.greatest(F.col("start_line"), hit["line"]))
    rows = chosen.where("start_line > 0 and end_line >= start_line").select(
        "request", "id", "file_path", "symbol", "choice", F.when(hit.isNull(), F.col("start_line")).otherwise(F.greatest("start_line", line - AROUND)).alias("start_line"),
        F.when(hit.isNull(), F.col("end_line")).otherwise(F.least("end_line", line + AROUND)).alias("end_line"), F.when(hit.isNull(), "callable_symbol_range").otherwise("semantic_mechanism_window").alias("reason"),
    )
    return top_per_group(rows, ["request"], [F.col("choice")], most)


class Localization:
    """All stages for all requests. What several stages read is written once."""

    def __init__(self, requests: DataFrame, hits: DataFrame, symbols: DataFrame, edges: DataFrame, flows: DataFrame):
        requests, hits = written(described(requests)), written(hits)
        self.files = written(file_candidates(hits, symbols, requests))
        pool = callable_pool(self.files, symbols, hits).withColumns({"graph_depth": F.lit(0), "graph_confidence": F.lit(0.0), "graph_relations": F.array().cast("array<string>")})
        self.pool = written(pool)
        self.seeds = written(graph_seeds(rank_callables(self.pool, requests)))
        found = owners(self.seeds, symbols, edges, flows).withColumns({"file_rank": F.lit(FILES + 1), "coverage": F.lit(0), "direct": F.lit(0.0), "exact": F.lit(False), "graph_depth": F.lit(1)})
        self.owners = written(found)
        self.callables = written(diverse_callables(rank_callables(self.pool.unionByName(self.owners), requests)))
        self.ranges = source_ranges(self.callables)

    def stages(self) -> DataFrame:
        """(request, stage, place, id, file_path, score, start_line, end_line) of all stages."""
        row = lambda df, stage, place, **columns: df.select("request", F.lit(stage).alias("stage"), F.col(place).cast("int").alias("place"), *(columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in (("id", "long"), ("file_path", "string"), ("score", "double"), ("start_line", "int"), ("end_line", "int"))))
        c = F.col
        return reduce(DataFrame.unionByName, [
            row(self.files, "file", "file_rank", file_path=c("file_path"), score=c("score")),
            row(self.pool, "pool", "file_rank", id=c("id"), file_path=c("file_path"), score=c("direct")),
            row(self.seeds, "seed", "seed", id=c("id"), file_path=c("file_path")),
            row(self.owners, "owner", "graph_depth", id=c("id"), file_path=c("file_path"), score=c("graph_confidence")),
            row(self.callables, "callable", "choice", id=c("id"), file_path=c("file_path"), score=c("localization_score"), start_line=c("start_line"), end_line=c("end_line")),
            row(self.ranges, "range", "choice", id=c("id"), file_path=c("file_path"), start_line=c("start_line"), end_line=c("end_line")),
        ])


# --- evidence -------------------------------------------------------------------------------------------------------

ALTERNATIVES, GAP = 2, 2.0


def callable_evidence(callables: DataFrame, ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, certainty, primary, alternatives) of every request.

    Alternatives are the next callables of another file or kind of owner than those before. The primary is `bounded` if
    it has a source range and either its kind of owner is asked for and no alternative has it, or the request names the
    kind as its target and the primary's file has more behaviour words than those of all alternatives of the kind, or
    its score leads by GAP; else `uncertain`; without callables `unavailable`.
    """
    rows = callables.join(ranges.select("request", "file_path", "symbol", F.lit(True).alias("located")).distinct(), ["request", "file_path", "symbol"], "left")
    kind = F.coalesce("owner_kind", F.lit(""))
    lone = top_per_group(rows.withColumn("__kind", kind), ["request", "file_path", "__kind"], [F.col("choice")], 1)
    lone = top_per_group(lone, ["request"], [F.col("choice")], 1 + ALTERNATIVES)
    told = F.struct("choice", "id", "__kind", "located", "target_match", "kind_match", "coverage", F.col("localization_score").alias("score"), F.greatest(F.lit(0.0), F.coalesce(F.when(F.col("evidence_score") != 0, F.col("evidence_score")), "localization_score")).alias("evidence"))
    by = lone.groupBy("request").agg(F.array_sort(F.collect_list(told)).alias("rows")).withColumns({"p": F.element_at("rows", 1), "others": F.slice("rows", 2, ALTERNATIVES)})
    p, second = F.col("p"), F.try_element_at("others", F.lit(1))
    alone = F.forall("others", lambda o: o["__kind"] != p["__kind"])
    same = F.filter("others", lambda o: o["__kind"] == p["__kind"])
    dominates = (p["coverage"] > 0) & (F.size(same) > 0) & F.forall(same, lambda o: o["coverage"] < p["coverage"])
    lead = F.when(p["target_match"], p["score"] >= F.coalesce(second["score"], F.lit(0.0)) + GAP).otherwise(p["evidence"] >= F.coalesce(second["evidence"], F.lit(0.0)) + GAP)
    bounded = ((p["target_match"] | p["kind_match"]) & alone) | (p["target_match"] & dominates) | lead
    sure = F.when(F.coalesce(p["located"], F.lit(False)) & bounded, "bounded").otherwise("uncertain")
    found = by.select("request", sure.alias("certainty"), p["id"].alias("primary"), F.transform("others", lambda o: o["id"]).alias("alternatives"))
    none = F.array().cast("array<long>")
    return requests.select("request").join(found, "request", "left").select("request", F.coalesce("certainty", F.lit("unavailable")).alias("certainty"), "primary", F.coalesce("alternatives", none).alias("alternatives"))
