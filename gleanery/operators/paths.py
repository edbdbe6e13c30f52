"""Paths through an edge table: bounded searches against the direction of edges, scores of paths, promotion of neighbours, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .scoring import looked_up
from .tables import top_per_group

#: How sure kinds of evidence are, and how much a relation tells. Fixed values.
EVIDENCE = {"exact": 1.0, "static": 0.85, "heuristic": 0.5, "inferred": 0.3}
SPECIFICITY = {"awaits": 1.0, "registers_callback": 0.95, "handles_callback": 0.95, "dispatches_event": 0.9, "handles_event": 0.9, "routes_to": 0.85, "calls": 0.7, "uses_service": 0.6}
#: How much of a seed's score a neighbour can have, by relation; and what is lost on the way. Fixed values.
SEED_RATIO = {"configured_by": 0.8, "imports": 0.75, "passes_property": 0.95, "renders_component": 0.85, "routes_to": 0.95}
DECAY, REVERSE_ROUTE = 0.82, 0.9


def best_edges(edges: DataFrame) -> DataFrame:
    """Of edges with the same ends the surest, then the first."""
    return top_per_group(edges, ["source", "target"], [F.desc("confidence"), F.col("edge_id")], 1)


def reverse_paths(edges: DataFrame, seeds: DataFrame, entries: DataFrame, depth: int = 6, per_seed: int = 20) -> DataFrame:
    """(seed, nodes, hops, complete, truncated, entry, confidence, evidence, specificity): ways that lead to seeds.

    seeds: node; entries: node and score. A way ends at an entry (complete), where nothing leads on, or after `depth`
    hops (truncated). No node comes twice on a way; of each seed the per_seed ways of the largest sum of confidence go on,
    of equals the first by their nodes. Each layer is written, so plans do not grow.
    """
    step = best_edges(edges).select("source", "target", "confidence", looked_up(EVIDENCE, F.col("evidence_class"), 0.25).alias("evidence"), looked_up(SPECIFICITY, F.col("relation"), 0.5).alias("specificity"))
    step = written(step)
    entry = entries.select(F.col("node").alias("at"), F.col("score").alias("entry"))
    zero = F.lit(0.0)
    front = seeds.select(F.col("node").alias("seed"), F.col("node").alias("at"), F.array(F.col("node").cast("string")).alias("nodes"), F.lit(0).alias("hops"), zero.alias("confidence"), zero.alias("evidence"), zero.alias("specificity"))
    out = []
    for hop in range(depth + 1):
        told = front.join(entry, "at", "left")
        if hop == depth:
            out.append(_ended(told.where("entry is null"), False, True))
        out.append(_ended(told.where("entry is not null"), True, False))
        if hop == depth:
            break
        open_ = told.where("entry is null").drop("entry")
        grown = open_.join(step.select(F.col("source").alias("next"), F.col("target").alias("at"), F.col("confidence").alias("c"), F.col("evidence").alias("e"), F.col("specificity").alias("s")), "at")
        grown = grown.where(~F.array_contains("nodes", F.col("next").cast("string")))
        grown = grown.select("seed", F.col("next").alias("at"), F.concat(F.array(F.col("next").cast("string")), "nodes").alias("nodes"), (F.col("hops") + 1).alias("hops"), (F.col("confidence") + F.col("c")).alias("confidence"), (F.col("evidence") + F.col("e")).alias("evidence"), (F.col("specificity") + F.col("s")).alias("specificity"))
        out.append(_ended(open_.join(step.select(F.col("target").alias("at")), "at", "left_anti").withColumn("entry", F.lit(None).cast("double")), False, False))
        front = written(top_per_group(grown, ["seed"], [F.desc(F.round("confidence", 6)), F.array_join("nodes", ">")], per_seed))
    return reduce(DataFrame.unionByName, out)


def _ended(ways: DataFrame, complete: bool, truncated: bool) -> DataFrame:
    return ways.select("seed", "nodes", "hops", F.lit(complete).alias("complete"), F.lit(truncated).alias("truncated"), F.coalesce("entry", F.lit(0.2)).alias("entry"), "confidence", "evidence", "specificity")


def path_score() -> Column:
    """Score of a way from 0 to 1."""
    hops = F.greatest(F.lit(1), "hops")
    mean = lambda c, alone: F.when(F.col("hops") == 0, alone).otherwise(F.col(c) / hops)
    score = (
        0.24 * mean("evidence", 1.0) + 0.18 * mean("confidence", 0.0) + 0.2 * F.col("entry") + 0.12 / (1.0 + F.greatest(F.lit(0), F.col("hops") - 1) * 0.12)
        + 0.12 * F.when(F.col("complete"), 1.0).otherwise(0.35) + 0.14 * mean("specificity", 0.5) - F.when(F.col("truncated"), 0.2).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


#: Names at which ways into a program begin, and what each is worth. Fixed values.
ENTRY_NAMES = {"main": 0.8, "run": 0.8, "start": 0.8, "execute": 0.8, "handle": 0.8}
LIFECYCLE = ("onCreate", "onDestroy", "onForeground", "onBackground", "aboutToAppear", "aboutToDisappear", "onPageShow", "onPageHide", "onBackPress", "build")


def entry_score(kind: Column, name: Column, path: Column) -> Column:
    """What a node is worth as an entry, by the first rule that fits; null if it is none."""
    low, file = F.lower(name), F.regexp_extract(path, r"([^/]*)$", 1)
    app = path.endswith(".ets")
    return (
        F.when(app & name.isin(*LIFECYCLE), 1.0)
        .when(app & low.rlike("^(onclick|onchange|onsubmit|ontouch|handle)"), 0.95)
        .when(app & (kind == "file") & F.lower(file).contains("ability"), 0.9)
        .when(app & (kind == "file") & (F.concat(F.lit("/"), path).contains("/pages/") | file.endswith("Page.ets")), 0.85)
        .when(kind == "file", 0.5)
        .when(low.isin(*ENTRY_NAMES), 0.8)
        .when(low.rlike("^(on_|handle_|consume|subscribe)"), 0.75)
    )


def promoted(edges: DataFrame, scores: DataFrame, per_seed_relation: int = 1) -> DataFrame:
    """(node, score, relation): neighbours of scored nodes (node, score) that an edge lifts above their own score.

    Both directions count. A neighbour gets the least of the seed's score times the relation's ratio and its decayed score
    plus five times the edge's confidence; of several ways to a node the best counts.
    """
    own = edges.where(F.col("relation").isin(*SEED_RATIO))
    there = own.select(F.col("source").alias("seed"), F.col("target").alias("node"), "relation", "confidence", F.lit(DECAY).alias("decay"))
    back = own.select(F.col("target").alias("seed"), F.col("source").alias("node"), "relation", "confidence", F.when(F.col("relation") == "routes_to", REVERSE_ROUTE).otherwise(DECAY).alias("decay"))
    met = there.union(back).join(scores.select(F.col("node").alias("seed"), F.col("score").alias("s")), "seed")
    lifted = F.round(F.least(F.col("s") * looked_up(SEED_RATIO, F.col("relation"), 0.0), F.col("s") * F.col("decay") + 5 * F.col("confidence")), 6)
    best = met.select("node", "relation", lifted.alias("score")).groupBy("node").agg(F.max(F.struct("score", "relation")).alias("b")).select("node", "b.score", "b.relation")
    return best.join(scores.select("node", F.col("score").alias("own")), "node", "left").where(F.col("score") > F.coalesce("own", F.lit(0.0))).drop("own")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, per_layer: int) -> DataFrame:
    """(node, depth): what lies around seeds, whatever the direction; each layer takes the first nodes by their surest edge."""
    ends = edges.select("source", "target", "confidence")
    both = written(ends.union(ends.select("target", "source", "confidence")).groupBy("source", "target").agg(F.max("confidence").alias("confidence")))
    reached = front = written(seeds.select("node", F.lit(0).alias("depth")))
    for d in range(1, depth + 1):
        near = both.join(front.select(F.col("node").alias("source")), "source").groupBy(F.col("target").alias("node")).agg(F.max("confidence").alias("c"))
        front = written(near.join(reached, "node", "left_anti").orderBy(F.desc("c"), "node").limit(per_layer).select("node", F.lit(d).alias("depth")))
        reached = reached.union(front)
    return reached


def rule_findings(rules: list[dict], edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule_id, kind, source, target): what breaks rules about edges (source, relation, target) and nodes (node, layer).

    forbid_edge: an edge of that relation between those layers; require_edge: a node of the layer without such an edge;
    single_owner: a target with several sources. A rule without a relation or layer means any.
    """
    layer = lambda end: nodes.select(F.col("node").alias(end), F.col("layer").alias(f"{end}_layer"))
    told = edges.join(layer("source"), "source", "left").join(layer("target"), "target", "left")
    found = []
    for rule in rules:
        fits = reduce(lambda x, y: x & y, [F.lit(True), *(F.col(c) == rule[c] for c in ("relation", "source_layer", "target_layer") if rule.get(c))])
        head = [F.lit(rule["id"]).alias("rule_id"), F.lit(rule["kind"]).alias("kind")]
        if rule["kind"] == "forbid_edge":
            found.append(told.where(fits).select(*head, F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).distinct())
        elif rule["kind"] == "require_edge":
            own = nodes.where(F.col("layer") == rule["source_layer"]).select(F.col("node").alias("source"))
            found.append(own.join(told.where(fits).select("source"), "source", "left_anti").select(*head, F.col("source").cast("string").alias("source"), F.lit(None).cast("string").alias("target")))
        else:
            several = told.where(fits).groupBy("target").agg(F.countDistinct("source").alias("n")).where("n > 1")
            found.append(several.select(*head, F.lit(None).cast("string").alias("source"), F.col("target").cast("string").alias("target")))
    return reduce(DataFrame.unionByName, found)


def impact_links(edges: DataFrame, changed: DataFrame, most: int = 300) -> DataFrame:
    """(direction, source, relation, target, confidence): what depends on changed nodes and what they use; one link of each
    (source, relation, target), by evidence, then confidence."""
    ids = changed.select("node")
    into = edges.join(ids.withColumnRenamed("node", "target"), "target", "left_semi").join(ids.withColumnRenamed("node", "source"), "source", "left_anti").withColumn("direction", F.lit("dependent"))
    out = edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").withColumn("direction", F.lit("outgoing"))
    rank = looked_up(EVIDENCE, F.col("evidence_class"), 0.25)
    unique = top_per_group(into.unionByName(out), ["direction", "source", "relation", "target"], [F.desc(rank), F.desc("confidence"), F.col("edge_id")], 1)
    chosen = top_per_group(unique, ["direction"], [F.desc(rank), F.desc("confidence"), F.col("edge_id")], most)
    return chosen.select("direction", "source", "relation", "target", "confidence")
