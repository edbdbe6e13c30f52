"""Changes of record tables as new snapshots: merges, promotions, scoped rewrites, and sources that become records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_records(records: DataFrame, group: list[str], body: str) -> DataFrame:
    """A new snapshot: active records of one group become one (the least id stays, with all bodies in order), the others are
    marked merged into it. Columns id, status, merged_into and the body."""
    active = records.where("status = 'active'")
    by = active.groupBy(*group).agg(F.min("id").alias("__into"), F.count("*").alias("__n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.col(body).alias("b")))), lambda x: x["b"]), "; ").alias("__body"))
    told = records.join(by.where("__n > 1"), group, "left")
    mine = (F.col("status") == "active") & F.col("__into").isNotNull()
    return told.select(
        *group, "id", F.when(mine & (F.col("id") == F.col("__into")), F.col("__body")).otherwise(F.col(body)).alias(body),
        F.when(mine & (F.col("id") != F.col("__into")), "merged").otherwise(F.col("status")).alias("status"),
        F.when(mine & (F.col("id") != F.col("__into")), F.col("__into")).alias("merged_into"),
    )


def promoted_records(records: DataFrame, facts: DataFrame, worthy: Column, fact: Column) -> tuple[DataFrame, DataFrame]:
    """Facts with those that worthy active records become, and records with these marked promoted. facts: source_id, fact."""
    chosen = records.where(worthy & (F.col("status") == "active"))
    fresh = chosen.select(F.col("id").alias("source_id"), fact.alias("fact")).join(facts.select("source_id"), "source_id", "left_anti")
    marked = records.withColumn("status", F.when(worthy & (F.col("status") == "active"), "promoted").otherwise(F.col("status")))
    return facts.select("source_id", "fact").unionByName(fresh), marked


def rewritten_scope(current: DataFrame, incoming: DataFrame, scope: str, generation: str) -> DataFrame:
    """A new snapshot: incoming rows replace all rows of the scopes they touch, one generation later; other scopes stay."""
    touched = current.groupBy(scope).agg(F.max(generation).alias("__g"))
    fresh = incoming.join(touched, scope, "left").withColumn(generation, F.coalesce(F.col("__g"), F.lit(0)) + 1).drop("__g")
    return current.join(incoming.select(scope).distinct(), scope, "left_anti").unionByName(fresh.select(*current.columns))


def counted_use(records: DataFrame, uses: DataFrame, key: str, time: str) -> DataFrame:
    """Records with use_count and last_used_at, counted from appended use events; reading writes nothing."""
    counts = uses.groupBy(key).agg(F.count("*").alias("use_count"), F.max(time).alias("last_used_at"))
    return records.join(counts, key, "left").withColumn("use_count", F.coalesce("use_count", F.lit(0)))


def changed_only(before: DataFrame, after: DataFrame, key: str, digest: str, most: int) -> DataFrame:
    """(key, change) of rows added, removed or changed; none if they are more than `most` (then the whole is read anew)."""
    from .tables import snapshot_changes

    changes = snapshot_changes(before, after, key, digest).where("change <> 'unchanged'")
    return changes.join(F.broadcast(changes.agg(F.count("*").alias("__n")))).where(F.col("__n") <= most).drop("__n")


def diff_hunks(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """(path, start, length) of the hunks of unified diffs, in the new files; one diff text a row."""
    parts = diffs.select(F.explode(F.filter(F.split(text, r"(?m)^diff --git "), lambda p: F.length(p) > 0)).alias("part"))
    path = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?(\S+)", 1)
    heads = F.regexp_extract_all("part", F.lit(r"(?m)^@@ -\d+(?:,\d+)? (\+\d+(?:,\d+)?) @@"), F.lit(1))
    hunks = parts.select(path.alias("path"), F.explode(heads).alias("head"))
    return hunks.select("path", F.regexp_extract("head", r"\+(\d+)", 1).cast("int").alias("start"), F.coalesce(F.nullif(F.regexp_extract("head", r",(\d+)", 1), F.lit("")).cast("int"), F.lit(1)).alias("length"))


def commits(logs: DataFrame, text: str = "log") -> DataFrame:
    """(sha, author, subject, path) from blocks of a git log whose header fields are parted by \\x1f and followed by paths."""
    blocks = logs.select(F.explode(F.filter(F.split(text, "\n\n"), lambda b: F.length(F.trim(b)) > 0)).alias("block"))
    head, files = F.split(F.split("block", "\n")[0], "\x1f"), F.expr("slice(split(block, '\\n'), 2, size(split(block, '\\n')))")
    return blocks.select(head[0].alias("sha"), head[1].alias("author"), head[2].alias("subject"), F.explode_outer(F.filter(files, lambda f: F.length(f) > 0)).alias("path"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href) of all links of pages."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"<a [^>]*href=\"([^\"]*)\""), F.lit(1))
    return pages.select(key, F.explode(found).alias("href"))


def excerpts(lines: DataFrame, group: str, number: str, match: Column, around: int) -> DataFrame:
    """(group, start, end): windows of lines around matches, those that touch joined."""
    from .tables import merged_intervals

    hits = lines.where(match).select(group, (F.col(number) - around).alias("start"), (F.col(number) + around).alias("end"))
    return merged_intervals(hits, [group], "start", "end")


def manifest(tables: dict[str, DataFrame], key: str, time: str, cutoff: str) -> DataFrame:
    """(name, rows, digest) of the rows of tables up to a time; the digest does not depend on their order."""
    from functools import reduce

    def one(name: str, df: DataFrame) -> DataFrame:
        rows = df.where(F.col(time) <= F.lit(cutoff).cast("timestamp"))
        return rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(F.crc32(F.col(key).cast("string")).cast("long")), F.lit(0)).alias("digest"))

    return reduce(DataFrame.unionByName, (one(n, df) for n, df in tables.items()))
