"""Selections that go beyond a top-k: caps by several keys, diversity, reserved places, and merges of several lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import top_per_group


def _by_group(df: DataFrame, group: str, order: list[Column], pool: int, choose) -> DataFrame:
    """Chooses rows of each group one after the other, from its first `pool` rows: memory is bounded, whatever a group holds."""
    ranked = top_per_group(df, [group], order, pool)
    placed = ranked.withColumn("__order", F.row_number().over(Window.partitionBy(group).orderBy(*order)))

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__order", kind="stable")
        return rows.iloc[list(choose(rows.to_dict("records")))].drop(columns="__order")

    return placed.groupBy(group).applyInPandas(go, df.schema)


def capped(df: DataFrame, group: str, order: list[Column], caps: dict[str, dict | int], most: int) -> DataFrame:
    """The first rows of each group of which no key has more than its cap: caps of a column, for all its values or by value.

    Null and empty values of a column are not capped. All rows of a group count, however many there are: of rows that agree
    in all capped columns only as many as the least of their caps can ever be taken, so the others go first, by a window. With
    one capped column that is all; with several, rows are read in order and tasks keep only the counts of the group at hand.
    """

    def limit(c: str) -> Column:
        given = caps[c]
        by_value = F.coalesce(F.create_map(*(F.lit(x) for kv in given.items() for x in kv))[F.col(c)], F.lit(3)) if isinstance(given, dict) else F.lit(given)
        return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", most).otherwise(by_value)

    nth = F.row_number().over(Window.partitionBy(group, *caps).orderBy(*order))
    rows = df.withColumn("__nth", nth).where(F.col("__nth") <= F.least(F.lit(most), F.lit(most), *map(limit, caps))).drop("__nth")
    if len(caps) == 1:
        return top_per_group(rows, [group], order, most)
    rows = rows.withColumn("__order", F.row_number().over(Window.partitionBy(group).orderBy(*order)))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen, taken = object(), {}, 0
        for batch in batches:
            keep = []
            for i, row in enumerate(batch.to_dict("records")):
                if row[group] != at:
                    at, seen, taken = row[group], {}, 0
                keys = [(c, row[c]) for c in caps if not pd.isna(row[c]) and row[c] != ""]
                most_of = lambda c, v: caps[c].get(v, 3) if isinstance(caps[c], dict) else caps[c]
                if taken < most and all(seen.get(k, 0) < most_of(*k) for k in keys):
                    keep.append(i)
                    taken += 1
                    for k in keys:
                        seen[k] = seen.get(k, 0) + 1
            yield batch.iloc[keep].drop(columns="__order")

    return rows.repartition(group).sortWithinPartitions(group, "__order").mapInPandas(go, df.schema)


def diverse(df: DataFrame, group: str, order: list[Column], tokens: str, place: str, alike: float = 0.3, per_place: int = 2, most: int = 10, pool: int = 1000) -> DataFrame:
    """The first rows of each group that are not alike (Jaccard of their tokens) to one chosen before, at most so many of a place.

    Places that stay free are filled with what was passed over, in order. Rows beyond the first `pool` of a group are not
    looked at: the pool is what a request recalls, and bounds what a task holds.
    """

    def choose(rows: list[dict]) -> list[int]:
        chosen: list[int] = []
        later: list[int] = []
        sets = [set(r[tokens]) for r in rows]
        for i, row in enumerate(rows):
            near = any(sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= alike for j in chosen)
            if near or sum(rows[j][place] == row[place] for j in chosen) >= per_place:
                later.append(i)
            else:
                chosen.append(i)
            if len(chosen) == most:
                break
        return [*chosen, *later[: most - len(chosen)]]

    return _by_group(df, group, order, pool, choose)


def with_reserved(df: DataFrame, group: str, order: list[Column], special: Column, least: int, most: int) -> DataFrame:
    """The first rows of each group, among them at least so many special ones if there are: they replace the last others."""
    by = Window.partitionBy(group).orderBy(*order)
    placed = df.withColumns({"__special": special, "__place": F.row_number().over(by)})
    own = Window.partitionBy(group, "__special").orderBy("__place")
    ranked = placed.withColumn("__nth", F.row_number().over(own))
    first = F.when(F.col("__special") & (F.col("__nth") <= least), 0).otherwise(1)
    kept = ranked.withColumn("__kept", F.row_number().over(Window.partitionBy(group).orderBy(first, "__place")))
    return kept.where(F.col("__kept") <= most).select(*df.columns)


def best_paths(df: DataFrame, seed: str, entry: str, known: Column, order: list[Column], per_entry: int = 2, most: int = 5) -> DataFrame:
    """At most so many rows of each seed and of each of its entries; unknown entries only where a seed has no known one."""
    told = df.withColumn("__known", known)
    any_known = told.withColumn("__any", F.max(F.col("__known").cast("int")).over(Window.partitionBy(seed)))
    fit = any_known.where(F.col("__known") | (F.col("__any") == 0)).select(*df.columns)
    return top_per_group(top_per_group(fit, [seed, entry], order, per_entry), [seed], order, most)


def queue(sources: dict[str, DataFrame], k: int) -> DataFrame:
    """(queue, id, priority): the first k of scored lists (id, priority), best first; each gives k rows at most."""
    from functools import reduce

    offered = [df.select(F.lit(name).alias("queue"), F.col("id").cast("string").alias("id"), F.col("priority").cast("double").alias("priority")).orderBy(F.desc("priority"), F.desc("id")).limit(k) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, offered).orderBy(F.desc("priority"), F.desc("queue"), F.desc("id")).limit(k)


def keep_best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by the order."""
    return top_per_group(df, key, order, 1)
