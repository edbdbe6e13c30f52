"""Calls through a class hierarchy: which methods a call may reach, and which files a changed hierarchy makes stale.

Tables: entities (key, kind, name, owner_name, qualified_name, file_path, signature); relations (source_key, relation,
target_key, target_qualified, line, confidence, arity), where hierarchy relations name the parent in target_qualified.
Types are told apart by name, as calls name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import written
from .tables import top_per_group

#: Limits and relations. Fixed values.
CANDIDATES, DEPTH, CONFIDENCE, CONTRACT = 8, 4, 0.55, 0.8
CALLS, HIERARCHY, STALE = ("calls", "awaits"), ("extends", "implements"), ("dispatches_via", "implements", "extends")
SCOPE = 2000
#: So many candidates of a key are one list; sources that may need more meet them row by row.
LISTED = 64
#: Up to so many lists go to all tasks.
SENT = 8192


def parents(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(child, parent) of all types, by name."""
    named = entities.select(F.col("key").alias("source_key"), F.col("name").alias("child"))
    up = relations.where(F.col("relation").isin(*HIERARCHY) & (F.coalesce("target_qualified", F.lit("")) != ""))
    return up.join(named, "source_key").select("child", F.col("target_qualified").alias("parent")).distinct()


def ancestors(pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(child, ancestor, depth) within so many steps, with the least number of steps. Only new ancestors go on, so cycles end."""
    step = pairs.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    front = written(pairs.select("child", F.col("parent").alias("ancestor")))
    found = front.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        new = front.join(step, "ancestor").select("child", F.col("next").alias("ancestor")).distinct()
        front = written(new.join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti"))
        found = found.unionByName(front.withColumn("depth", F.lit(d)))
    return found


def _named() -> tuple[Column, Column]:
    """The type and the method that a call names."""
    return F.regexp_extract("target_qualified", r"^(.+)\.([^.]+)$", 1).alias("receiver"), F.regexp_extract("target_qualified", r"^(.+)\.([^.]+)$", 2).alias("method")


def _near(calls: DataFrame, known: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """The candidates of sources that reach few methods: those of a key are one list, met once a call.

    All steps keep the calls of a source where they are, so only calls move, not their candidates.
    """
    lists = ranked.where(F.col("__rank") <= LISTED).groupBy("receiver", "method", "arity").agg(F.array_sort(F.collect_list(F.struct("__rank", "target_key", "qualified_name"))).alias("__list"))
    lists = written(lists)
    lists = F.broadcast(lists) if lists.count() <= SENT else lists
    few = F.size("__known") <= LISTED - most - 1
    calls = calls.join(known, ["source_key", "relation"], "left").where(F.col("__known").isNull() | few)
    confidence = F.least("confidence", F.lit(CONFIDENCE))
    turn = F.dense_rank().over(Window.partitionBy("source_key", "relation").orderBy(F.col("line"), confidence.desc()))
    met = calls.withColumn("__turn", turn.cast("long")).join(lists, ["receiver", "method", "arity"])
    seen = F.slice("__list", 1, F.coalesce(F.size("__known"), F.lit(0)) + most + 1)
    rest = F.when(F.col("__known").isNull(), seen).otherwise(F.filter(seen, lambda x: ~F.array_contains("__known", x["target_key"])))
    met = met.select("source_key", "relation", "line", confidence.alias("confidence"), "__turn", rest.alias("__rest"))
    met = met.withColumn("__turn", 2 * F.col("__turn") + (F.size("__rest") > most).cast("long"))  # of equal calls the one that tells all comes first
    each = met.select("source_key", "relation", "line", "confidence", "__turn", F.explode(F.slice("__rest", 1, most)).alias("x")).select("*", "x.target_key", "x.qualified_name")
    first = each.groupBy("source_key", "relation", "target_key", "qualified_name").agg(F.min_by("line", "__turn").alias("line"), F.min_by("confidence", "__turn").alias("confidence"), F.min("__turn").alias("__turn"))
    return first.select("source_key", "relation", "target_key", F.col("qualified_name").alias("target_qualified"), "line", "confidence", F.lit("inferred").alias("evidence_class"), (F.col("__turn") % 2 == 1).alias("truncated"))


def _far(calls: DataFrame, known: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """The same for sources that reach many methods already: a call meets one row a candidate."""
    count = known.groupBy("source_key", "relation").agg(F.count("*").alias("__known"))
    calls = calls.join(count, ["source_key", "relation"]).withColumn("__reach", F.col("__known") + most + 1).drop("__known")
    met = calls.join(ranked, ["receiver", "method", "arity"]).where("__rank <= __reach").join(known, ["source_key", "relation", "target_key"], "left_anti")
    key = ["source_key", "relation", "receiver", "method", "arity"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("__rank"))
    placed = met.withColumn("__place", place).withColumn("truncated", F.count("*").over(Window.partitionBy(*key)) > most).where(F.col("__place") <= most)
    found = placed.select("source_key", "relation", "target_key", F.col("qualified_name").alias("target_qualified"), "line", F.least("confidence", F.lit(CONFIDENCE)).alias("confidence"), F.lit("inferred").alias("evidence_class"), "truncated")
    return top_per_group(found, ["source_key", "relation", "target_key"], [F.col("line"), F.desc("confidence"), F.col("truncated")], 1)


def dispatch_candidates(entities: DataFrame, relations: DataFrame, most: int = CANDIDATES, depth: int = DEPTH) -> DataFrame:
    """(source_key, relation, target_key, target_qualified, line, confidence, evidence_class, truncated) that calls add.

    A call names a type and a method (`Type.method`). Candidates are methods of that name, and of that number of
    arguments if the call tells it, of types below the named one; those that the source reaches already are left out,
    and of the others the first `most` by file, name and signature count (truncated tells that there are more). A source's
    calls of one method with one number of arguments are one call. A call of a type that has types below it, or that is an
    interface, also depends on the type itself (dispatches_via).
    """
    pairs = written(parents(entities, relations))
    methods = entities.where(F.col("kind").isin("function", "method") & (F.coalesce("owner_name", F.lit("")) != ""))
    methods = methods.select("key", "name", "owner_name", "file_path", "qualified_name", "signature", T.argument_count(F.col("signature")).alias("__arity")).dropDuplicates(["key"])
    below = ancestors(pairs, depth).select(F.col("child").alias("owner_name"), F.col("ancestor").alias("receiver"))
    arity = F.explode(F.when(F.col("__arity").isNull(), F.array(F.lit(-1))).otherwise(F.array(F.lit(-1), F.col("__arity"))))  # -1: any number
    by = Window.partitionBy("receiver", "method", "arity").orderBy("file_path", "qualified_name", "signature", "target_key")
    ranked = methods.join(below, "owner_name").select("receiver", F.col("name").alias("method"), arity.alias("arity"), F.col("key").alias("target_key"), "file_path", "qualified_name", "signature")
    ranked = ranked.withColumn("__rank", F.row_number().over(by)).drop("file_path", "signature")

    calling = relations.where(F.col("relation").isin(*CALLS))
    known = calling.where(F.col("target_key").isNotNull()).groupBy("source_key", "relation").agg(F.collect_set("target_key").alias("__known"))
    # Of the methods of a key so many may fall away as the source reaches already: no more than these are looked at.
    far = written(known.where(F.size("__known") > LISTED - most - 1).select("source_key", "relation"))
    told = calling.select("source_key", "relation", "line", "confidence", F.coalesce("arity", F.lit(-1)).alias("arity"), *_named()).where("receiver <> '' and method <> ''")
    calls = told.repartition("source_key", "relation").groupBy("source_key", "relation", "receiver", "method", "arity").agg(F.min("line").alias("line"), F.max("confidence").alias("confidence"))
    found = _near(calls, known, ranked, most)
    if not far.isEmpty():
        deep = calling.join(far, ["source_key", "relation"], "left_semi")
        found = found.unionByName(_far(calls.join(far, ["source_key", "relation"], "left_semi"), deep.where(F.col("target_key").isNotNull()).select("source_key", "relation", "target_key").distinct(), ranked, most))

    types = entities.where(~F.col("kind").isin("function", "method")).groupBy(F.col("qualified_name").alias("receiver")).agg(F.min("key").alias("target_key"), F.max(F.col("kind") == "interface").alias("__interface"))
    above = pairs.select(F.col("parent").alias("receiver"), F.lit(True).alias("__parent")).distinct()
    via = told.groupBy("source_key", "receiver").agg(F.min("line").alias("line")).join(above, "receiver", "left").join(types, "receiver", "left").where("coalesce(__parent, false) or coalesce(__interface, false)")
    via = via.select("source_key", F.lit("dispatches_via").alias("relation"), "target_key", F.col("receiver").alias("target_qualified"), "line", F.lit(CONTRACT).alias("confidence"), F.lit("static").alias("evidence_class"), F.lit(False).alias("truncated"))
    return found.unionByName(via)


_DECLARED = r"\b(?:class|struct)\s+[A-Za-z_$][\w$]*(?:\s+extends\s+([A-Za-z_$][\w$]*))?(?:[^\n{]*?\s+implements\s+([^\n{]+))?"


def declared_parents(files: DataFrame) -> DataFrame:
    """(path, parent): the types that the classes in a file's text extend or implement."""
    every = lambda group: F.regexp_extract_all("text", F.lit(_DECLARED), F.lit(group))
    listed = F.flatten(F.transform(every(2), lambda x: F.split(x, ",")))
    names = F.transform(F.concat(every(1), listed), lambda n: F.regexp_extract(F.trim(n), r"^([A-Za-z_$][\w$]*)", 1))
    return files.where("lower(path) rlike '[.](ets|ts|tsx)$'").select("path", F.explode(names).alias("parent")).where("parent <> ''").distinct()


def rebuild_scope(changed: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = SCOPE) -> DataFrame:
    """(path): the files to index again when files (path, new text) change, the first `most` by path.

    Contracts are what the changed files' symbols extended or implemented, and what their new text names. Stale are the files
    of contracts and of all symbols that depend on one. symbols (id, symbol, file_path), edges (source, relation, target).
    """
    own = symbols.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(F.col("id").alias("source"))
    old = edges.where(F.col("relation").isin(*HIERARCHY)).join(own, "source", "left_semi").select(F.col("target").alias("id"))
    new = symbols.join(declared_parents(changed).select(F.col("parent").alias("symbol")).distinct(), "symbol", "left_semi").select("id")
    contracts = written(old.unionByName(new).distinct())
    near = edges.where(F.col("relation").isin(*STALE)).join(contracts.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    stale = contracts.unionByName(near).distinct()
    return symbols.join(stale, "id", "left_semi").where("file_path is not null").select(F.col("file_path").alias("path")).distinct().orderBy("path").limit(most)
