"""Records that say the same or contradict each other, found by shared tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import written

PROCEDURES = ("procedure_experience", "correction_experience")


def similar_pairs(df: DataFrame, id_col: str, tokens_col: str, least: float) -> DataFrame:
    """(id_a, id_b, similarity) of rows whose token sets have at least that Jaccard similarity.

    Rows with equal sets are one class first. Two sets can be that similar only if they share a token among the rarest
    n - ceil(least n) + 1 of each, so only those meet; classes are compared once and opened to their rows at the end.
    """
    sized = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens_col)).alias("t")).where(F.size("t") > 0)
    classes = sized.groupBy("t").agg(F.min("id").alias("class"), F.array_sort(F.collect_list("id")).alias("members"))
    counts = classes.select("class", F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    each = classes.select("class", "t", F.explode("t").alias("token")).join(counts, "token")
    rarest = each.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by"), F.first("t").alias("t"))
    n = F.size("t")
    prefix = F.transform(F.slice("by", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1), lambda x: x["token"])
    probes = rarest.select("class", n.alias("n"), F.explode(prefix).alias("token"))
    a, b = (probes.select(F.col("class").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), "token") for x in "ab")
    near = (F.col("n_a") >= least * F.col("n_b") - 1e-9) & (F.col("n_b") >= least * F.col("n_a") - 1e-9)
    met = a.join(b, "token").where((F.col("c_a") < F.col("c_b")) & near).select("c_a", "c_b").distinct()
    sets = classes.select("class", "t", "members")
    told = met
    for x in "ab":
        told = told.join(sets.select(F.col("class").alias(f"c_{x}"), F.col("t").alias(f"t_{x}"), F.col("members").alias(f"m_{x}")), f"c_{x}")
    told = told.withColumn("similarity", F.round(T.jaccard(F.col("t_a"), F.col("t_b")), 6)).where(F.col("similarity") >= least)
    across = told.select(F.explode("m_a").alias("x"), "m_b", "similarity").select("x", F.explode("m_b").alias("y"), "similarity")
    within = classes.where(F.size("members") > 1).select("members", F.explode("members").alias("x")).select("x", F.explode("members").alias("y"), F.lit(1.0).alias("similarity")).where("x < y")
    return across.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def _tokens(name: str):
    return F.array_distinct(T.tokens(F.coalesce(F.col(name), F.lit(""))))


def conflicting_procedures(records: DataFrame, trigger: float = 0.8, scope: float = 0.5, repair: float = 0.75) -> DataFrame:
    """(older, newer) of one type whose triggers and scopes are alike and whose repairs are not.

    Alike: equal, or Jaccard of at least the given value; candidates share a rare token of the trigger. Records that say the same
    are one case. Triggers, then scopes, then repairs are compared once a case; only cases that conflict open to their records.
    """
    told = records.where(F.col("repair_action").isNotNull() & F.col("trigger_condition").isNotNull() & F.col("scope").isNotNull() & F.col("experience_type").isin(*PROCEDURES))
    sets = {name: F.array_sort(_tokens(c)).alias(name) for name, c in (("t", "trigger_condition"), ("s", "scope"), ("r", "repair_action"))}
    rows = told.select("id", "experience_type", *sets.values(), F.col("repair_action").alias("action")).where(F.size("t") > 0)
    named = lambda *c: F.sha2(F.to_json(F.struct(*c)), 256)
    rows = rows.withColumns({"trigger": named("t"), "place": named("experience_type", "t", "s"), "case": named("experience_type", "t", "s", "r", "action")})
    cases = written(rows.groupBy("experience_type", "trigger", "place", "case").agg(*(F.first(c).alias(c) for c in ("t", "s", "r", "action"))))
    triggers = cases.groupBy("trigger").agg(F.first("t").alias("t"))
    alike = similar_pairs(triggers, "trigger", "t", trigger).select(F.col("id_a").alias("trigger_a"), F.col("id_b").alias("trigger_b")).union(triggers.select("trigger", "trigger"))
    side = lambda df, x, *shared: df.select(*shared, *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in shared))
    places = cases.groupBy("experience_type", "trigger", "place").agg(F.first("s").alias("s"))
    met = alike.join(side(places, "a", "experience_type"), "trigger_a").join(side(places, "b", "experience_type"), ["experience_type", "trigger_b"])
    met = met.where(((F.col("trigger_a") != F.col("trigger_b")) | (F.col("place_a") <= F.col("place_b"))) & (T.jaccard(F.col("s_a"), F.col("s_b")) >= scope)).select("place_a", "place_b")
    own = cases.select("place", "case", "r", "action")
    met = met.join(side(own, "a"), "place_a").join(side(own, "b"), "place_b").where((F.col("place_a") != F.col("place_b")) | (F.col("case_a") < F.col("case_b")))
    met = met.where((F.col("action_a") != F.col("action_b")) & (T.jaccard(F.col("r_a"), F.col("r_b")) < repair)).select("case_a", "case_b")
    members = rows.select("case", "id")
    pairs = met.join(side(members, "a"), "case_a").join(side(members, "b"), "case_b").where("id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias("older"), F.greatest("id_a", "id_b").alias("newer"))


def conflicting_values(records: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., older, newer): for each key, records one after the other that propose another value than the one before."""
    from pyspark.sql import Window

    by = Window.partitionBy(*key).orderBy("id")
    before = records.where(F.col(value).isNotNull()).withColumns({"older": F.lag("id").over(by), "__before": F.lag(value).over(by)})
    return before.where(F.col("__before") != F.col(value)).select(*key, "older", F.col("id").alias("newer"))


def interference(records: DataFrame) -> DataFrame:
    """Records that may mislead: a misleading outcome or score from .6, or misleading at all and used three times."""
    return records.where((F.coalesce("last_outcome", F.lit("")) == "misleading") | (F.col("misleading") >= 0.6) | ((F.col("misleading") > 0) & (F.col("use_count") >= 3)))
