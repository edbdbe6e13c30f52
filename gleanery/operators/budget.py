"""Records cut to a budget of tokens: an ordered list of reductions, each applied only while a record is still too large.

A handoff is a row with the columns below. Its size is that of its JSON without null fields, four characters a token. The
reductions are projections, one behind the other: each measures the record again and changes a column or two of the rows
that do not fit yet. So all rows go through the same eighteen steps within their tasks; nothing is shuffled and there is no
loop over rows.

- relation_hints, log_keywords, experience_refs, semantic_refs: lists of strings
- log_anchors: (evidence_class, log_id, message)
- code_anchors: (file_path, symbol, excerpt)
- paths: (path_id, entry, emitter, relations, nodes, expected_logs, uncertainty, projection); the first is the primary one
- callable: (certainty, file_path, symbol, reasons, alternatives)
- correction_guards, semantic_patch_notes, blocked_notes, conflict_notes: (id, fact, detail)

Null lists count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("relation_hints", "log_keywords", "experience_refs", "semantic_refs", "log_anchors", "code_anchors", "paths", "callable", "correction_guards", "semantic_patch_notes", "blocked_notes", "conflict_notes")
GUARDS = ("correction_guards", "semantic_patch_notes", "blocked_notes", "conflict_notes")
#: Tokens kept free, and the characters of a fact that is cut. Fixed values.
RESERVE, FACT = 60, 100

Changes = dict[str, Column]


def tokens(columns: tuple[str, ...] = COLUMNS) -> Column:
    """The size of a record."""
    return F.greatest(F.lit(1), F.floor(F.length(F.to_json(F.struct(*columns))) / 4)).cast("int")


def _head(name: str, n: int) -> Callable[[], Changes]:
    return lambda: {name: F.slice(name, 1, n)}



def _each_path(change: Callable[[Column], Column]) -> Changes:
    return {"paths": F.transform("paths", change)}


def _cut(field: str, n: int) -> Callable[[Column], Column]:
    return lambda p: p.withField(field, F.slice(p[field], 1, n))


def _minimal_callable() -> Changes:
    c = F.col("callable")
    return {"callable": F.when(c.isNotNull() & c["symbol"].isNotNull(), c.withField("reasons", F.lit(None).cast("array<string>")).withField("alternatives", F.array().cast("array<string>"))).otherwise(c)}


def _minimal_guards() -> Changes:
    return {g: F.transform(g, lambda x: x.withField("detail", F.lit(None).cast("string"))) for g in GUARDS}


def _excerpt_apart_from_paths() -> Changes:
    """With two paths or more, the last excerpt of a file that emits on neither of the first two goes."""
    files = F.transform(F.slice("paths", 1, 2), lambda p: p["emitter"])
    places = F.transform("code_anchors", lambda a, i: F.when(a["excerpt"].isNotNull() & ~F.array_contains(files, a["file_path"]), i))
    last = F.array_max(places)
    without = F.transform("code_anchors", lambda a, i: F.when(i == last, a.withField("excerpt", F.lit(None).cast("string"))).otherwise(a))
    return {"code_anchors": F.when((F.size("paths") >= 2) & last.isNotNull(), without).otherwise(F.col("code_anchors"))}


def _compressed_primary() -> Changes:
    """What the primary path says twice goes: nodes that are its ends, logs that anchors hold, its uncertainty."""
    texts = lambda: F.lit(None).cast("array<string>")
    messages = F.transform("log_anchors", lambda a: a["message"])

    def compressed(p: Column) -> Column:
        ends = (F.size(p["nodes"]) == 2) & (p["nodes"][0] == p["entry"]) & (p["nodes"][1] == p["emitter"])
        known = (F.size(p["expected_logs"]) > 0) & F.forall(p["expected_logs"], lambda x: F.array_contains(messages, x))
        p = p.withField("relations", F.slice(p["relations"], 1, 5)).withField("nodes", F.when(ends, texts()).otherwise(p["nodes"]))
        return p.withField("expected_logs", F.when(known, texts()).otherwise(p["expected_logs"])).withField("uncertainty", texts())

    return {"paths": F.transform("paths", lambda p, i: F.when(i == 0, compressed(p)).otherwise(p))}


def _compressed_alternate() -> Changes:
    """Of other paths one stays, as an entry."""
    texts = lambda: F.lit(None).cast("array<string>")

    def entry(p: Column) -> Column:
        p = p.withField("relations", F.slice(p["relations"], 1, 2)).withField("emitter", F.lit(None).cast("string")).withField("projection", F.lit("alternate_entry"))
        return p.withField("nodes", texts()).withField("expected_logs", texts()).withField("uncertainty", texts())

    two = F.transform(F.slice("paths", 1, 2), lambda p, i: F.when(i == 1, entry(p)).otherwise(p))
    return {"paths": F.when(F.size("paths") >= 2, two).otherwise(F.col("paths"))}


def bounded_logs(anchors: Column, n: int) -> Column:
    """The first so many log anchors; where there are more, a direct one and those of its log come first."""
    placed = F.transform(anchors, lambda a, i: F.struct(i.alias("i"), a.alias("a")))
    direct = F.try_element_at(F.filter(placed, lambda x: x["a"]["evidence_class"] == "direct"), F.lit(1))
    same = lambda x: (x["i"] != direct["i"]) & F.coalesce(x["a"]["log_id"] == direct["a"]["log_id"], F.lit(False))
    rest = lambda x: (x["i"] != direct["i"]) & ~F.coalesce(x["a"]["log_id"] == direct["a"]["log_id"], F.lit(False))
    first = F.concat(F.array(direct["a"]), F.transform(F.filter(placed, same), lambda x: x["a"]), F.transform(F.filter(placed, rest), lambda x: x["a"]))
    return F.when((F.size(anchors) > n) & direct.isNotNull(), F.slice(first, 1, n)).otherwise(F.slice(anchors, 1, n))


def _hard_trim() -> Changes:
    none = F.array().cast("array<string>")

    def cut(p: Column) -> Column:
        for field, n in (("nodes", 4), ("relations", 3), ("expected_logs", 1)):
            p = p.withField(field, F.slice(p[field], 1, n))
        return p.withField("uncertainty", F.slice(F.coalesce(p["uncertainty"], none), 1, 1))

    fact = lambda g: F.transform(F.slice(g, 1, 1), lambda x: x.withField("fact", F.substring(x["fact"], 1, FACT)).withField("detail", F.lit(None).cast("string")))
    return {
        "log_keywords": F.slice("log_keywords", 1, 6), "log_anchors": bounded_logs(F.col("log_anchors"), 2), "code_anchors": F.slice("code_anchors", 1, 3), "relation_hints": none, "experience_refs": none, "semantic_refs": none,
        "paths": F.transform(F.slice("paths", 1, 1), cut), "correction_guards": fact("correction_guards"), "semantic_patch_notes": fact("semantic_patch_notes"), "conflict_notes": fact("conflict_notes"), "blocked_notes": F.slice("blocked_notes", 1, 0),
    }


#: The reductions in their order, which is fixed.
REDUCTIONS: tuple[Callable[[], Changes], ...] = (
    _head("relation_hints", 2), lambda: _each_path(_cut("expected_logs", 2)), lambda: _each_path(_cut("uncertainty", 1)), _head("code_anchors", 3), _head("log_keywords", 8), _minimal_callable,
    _head("experience_refs", 1), _head("semantic_refs", 1), _head("paths", 2), _head("blocked_notes", 1), _head("conflict_notes", 1), _minimal_guards, lambda: {"blocked_notes": F.slice("blocked_notes", 1, 0)},
    _excerpt_apart_from_paths, _compressed_primary, _compressed_alternate, _head("paths", 1), _hard_trim,
)


def reduced(handoffs: DataFrame, budget: Column, reserve: int = RESERVE) -> DataFrame:
    """Handoffs that fit their budget less the reserve, as far as the reductions go, with `reductions` (how many were
    applied), `tokens` (the size now) and `fits`."""
    kinds = {c: handoffs.schema[c].dataType.simpleString() for c in COLUMNS}
    lists = {c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in COLUMNS if c != "callable"}
    rows = handoffs.withColumns({**lists, "__most": budget - reserve, "reductions": F.lit(0)})
    for reduction in REDUCTIONS:
        rows = rows.withColumn("__over", tokens() > F.col("__most"))
        changes = {c: F.when(F.col("__over"), new.cast(kinds[c])).otherwise(F.col(c)) for c, new in reduction().items()}
        rows = rows.withColumns({**changes, "reductions": F.col("reductions") + F.col("__over").cast("int")})
    rows = rows.withColumn("tokens", tokens())
    return rows.withColumn("fits", F.col("tokens") <= F.col("__most")).drop("__over", "__most")
