"""Whether observed spans of source support what a case asserts, and whether the causal level that was claimed is reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import merged_intervals, overlapping

#: Causal levels, each of which holds for the ones before it; what is rejected holds for nothing else. Fixed values.
LEVELS = ("association", "supported", "verified")
#: Lines of a bucket in which spans meet.
WIDTH = 64


def level_reached(observed: Column, expected: Column) -> Column:
    """Whether an observed level satisfies an expected one; none expected is satisfied, unknown ones only by themselves."""
    a, b = F.lower(F.coalesce(observed, F.lit(""))), F.lower(F.coalesce(expected, F.lit("")))
    levels = F.array(*map(F.lit, LEVELS))
    known = F.array_contains(levels, a) & F.array_contains(levels, b)
    return F.when(b == "", True).when(known, F.array_position(levels, a) >= F.array_position(levels, b)).otherwise(a == b)


def covered(assertions: DataFrame, evidence: DataFrame, width: int = WIDTH) -> DataFrame:
    """(case, assertion, matched, lines, covered) of assertions (case, assertion, file_path, symbol, a, b).

    An assertion is matched by evidence (case, file_path, symbol, x, y) of its case and file, and of its symbol if it names one,
    whose lines overlap its own; covered counts its lines in the union of all such spans. Spans meet by case, file and
    bucket of lines, so a case with much evidence for one file is dealt over many tasks. Spans without lines count for nothing.
    """
    key = lambda df: F.concat_ws("\n", df["case"].cast("string"), df["file_path"])
    named = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    valid = lambda df, a, b: df.where((F.col(a) > 0) & (F.col(b) >= F.col(a)) & (F.coalesce("file_path", F.lit("")) != ""))
    left = valid(assertions, "a", "b").select(key(assertions).alias("__key"), "case", "assertion", named(F.col("symbol")).alias("__symbol"), "a", "b")
    right = valid(evidence, "x", "y").select(key(evidence).alias("__key"), named(F.col("symbol")).alias("__found"), "x", "y").distinct()
    met = overlapping(left, right, "__key", width).where("__symbol = '' or __symbol = __found")
    clipped = met.select("case", "assertion", F.greatest("a", "x").alias("x"), F.least("b", "y").alias("y")).distinct()
    told = merged_intervals(clipped, ["case", "assertion"], "x", "y").groupBy("case", "assertion").agg(F.sum(F.col("y") - F.col("x") + 1).alias("covered"))
    rows = assertions.select("case", "assertion", F.greatest(F.lit(0), F.coalesce(F.col("b") - F.col("a") + 1, F.lit(0))).alias("lines"))
    return rows.join(told, ["case", "assertion"], "left").select("case", "assertion", F.col("covered").isNotNull().alias("matched"), "lines", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def scored(cases: DataFrame, assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case, expected, matched, score, grounded, cover, level_ok) of cases (case, expected_level, observed_level).

    score is the share of assertions that are matched, grounded that all are, cover the share of their lines; all three are
    null for cases without assertions.
    """
    told = covered(assertions, evidence).groupBy("case").agg(F.count("*").alias("expected"), F.count_if("matched").alias("matched"), F.sum("lines").alias("lines"), F.sum("covered").alias("covered"))
    rows = cases.join(told, "case", "left").fillna(0, ["expected", "matched"])
    some = F.col("expected") > 0
    return rows.select(
        "case", "expected", "matched", F.when(some, F.round(F.col("matched") / F.col("expected"), 4)).alias("score"), F.when(some, F.col("matched") == F.col("expected")).alias("grounded"),
        F.when(F.col("lines") > 0, F.round(F.col("covered") / F.col("lines"), 4)).alias("cover"), level_reached(F.col("observed_level"), F.col("expected_level")).alias("level_ok"),
    )
