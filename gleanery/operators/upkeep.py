"""A written index that follows its table: segments of changes, tombstones, merges, and generations behind one pointer.

A folder holds `segments/<name>/{postings,lengths,gone}` and `generations/<number>`. A segment has the postings (id,
field, term, tf, doc_len) and the lengths (id, doc_len) of the passages that a batch of changes brought, and the ids that
the batch made stale in earlier segments. A generation is one row that lists its segments in order; it is written aside
and moved into place in one step, so a reader has either the old list or the new one, and what it has opened stays
as it is: segments never change. One writer works at a time; a second one that meets its generation's number fails.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .index import passage_length, postings

#: Segments from which a merge makes one, and ids that may be broadcast (8 bytes and more a row).
MANY, BROADCAST_ROWS = 8, 1_000_000
_GENERATION = "generation long, segments array<string>, source_revision string, fields array<string>, indexed long, retired long"


class Generation(NamedTuple):
    generation: int
    segments: list[str]
    source_revision: str
    fields: list[str]
    indexed: int
    retired: int


def current(spark: SparkSession, path: str) -> Generation | None:
    """The generation that the pointer names; none if nothing has been written."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/generations")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
    return Generation(*spark.read.schema(_GENERATION).parquet(f"{path}/generations/{names[-1]}").first()) if names else None


def _activate(spark: SparkSession, path: str, found: Generation) -> Generation:
    """Write a generation aside and move it into place."""
    aside = f"{path}/aside/{uuid.uuid4().hex}"
    spark.createDataFrame([tuple(found)], _GENERATION).coalesce(1).write.parquet(aside)
    of = spark._jvm.org.apache.hadoop.fs.Path
    target = of(f"{path}/generations/{found.generation:012d}")
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(of(aside), target):
        raise RuntimeError(f"generation {found.generation} has been written by another writer")
    return found


def _write(postings_: DataFrame, lengths: DataFrame, gone: DataFrame, path: str) -> str:
    name = uuid.uuid4().hex
    postings_.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/segments/{name}/postings")
    lengths.write.parquet(f"{path}/segments/{name}/lengths")
    gone.write.parquet(f"{path}/segments/{name}/gone")
    return name


def rebuild(passages: DataFrame, fields: list[str], path: str, source_revision: str = "") -> Generation:
    """A new generation of one segment with all passages (id and text fields)."""
    spark, before = passages.sparkSession, None
    before = current(spark, path)
    lengths = passages.select("id", passage_length(fields).cast("long").alias("doc_len"))
    name = _write(postings(passages, fields), lengths, passages.select("id").limit(0), path)
    old = before.indexed if before else 0
    return _activate(spark, path, Generation(before.generation + 1 if before else 1, [name], source_revision, fields, spark.read.parquet(f"{path}/segments/{name}/lengths").count(), old))


def apply(changes: DataFrame, path: str, source_revision: str = "") -> Generation:
    """A new generation with a batch of changes (id, op, sequence, text fields): op is insert, update or delete.

    Of several changes of one id the one with the highest sequence counts. Inserts of ids that are there replace them, updates
    of unknown ids insert them, deletes of unknown ids do nothing; so a batch may be applied again.
    """
    spark = changes.sparkSession
    before = current(spark, path)
    if before is None:
        raise RuntimeError("there is no index to change")
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sequence"), "op"))
    final = changes.where("id is not null").withColumn("__last", last).where("__last = 1")
    alive = final.where("op <> 'delete'")
    lengths = alive.select("id", passage_length(before.fields).cast("long").alias("doc_len"))
    name = _write(postings(alive.select("id", *before.fields), before.fields), lengths, final.select("id"), path)
    found = Generation(before.generation + 1, [*before.segments, name], source_revision, before.fields, 0, 0)
    new = opened(spark, path, found).lengths.count()
    retired = spark.read.parquet(f"{path}/segments/{name}/gone").join(opened(spark, path, before).lengths.select("id"), "id", "left_semi").count()
    found = _activate(spark, path, found._replace(indexed=new, retired=retired))
    return merge(spark, path) if len(found.segments) >= MANY else found


class Index(NamedTuple):
    """What a generation holds: postings, and the lengths of its passages."""

    postings: DataFrame
    lengths: DataFrame

    def statistics(self) -> DataFrame:
        """One row (n, mean_len)."""
        return self.lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean_len"))


def opened(spark: SparkSession, path: str, generation: Generation | None = None) -> Index:
    """The tables of a generation (the current one by default): rows that no later segment has made stale."""
    found = generation or current(spark, path)
    if found is None:
        raise RuntimeError("there is no index to open")
    read = lambda kind: [spark.read.parquet(f"{path}/segments/{name}/{kind}").withColumn("__segment", F.lit(i)) for i, name in enumerate(found.segments)]
    if len(found.segments) == 1:
        return Index(*(read(kind)[0].drop("__segment") for kind in ("postings", "lengths")))
    gone = reduce(DataFrame.unionByName, read("gone")[1:]).groupBy("id").agg(F.max("__segment").alias("__gone"))
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)

    def kept(kind: str) -> DataFrame:
        rows = reduce(DataFrame.unionByName, read(kind)).join(gone, "id", "left")
        return rows.where("__gone is null or __segment >= __gone").drop("__segment", "__gone")

    return Index(kept("postings"), kept("lengths"))


def merge(spark: SparkSession, path: str) -> Generation:
    """A new generation with all that the current one holds in one segment, without tombstones."""
    before = current(spark, path)
    index = opened(spark, path, before)
    name = _write(index.postings, index.lengths, index.lengths.select("id").limit(0), path)
    return _activate(spark, path, before._replace(generation=before.generation + 1, segments=[name], retired=0))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the segments that none of the last generations lists, and older generations; how many segments went."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    listed = lambda folder: sorted(f.getPath().getName() for f in fs.listStatus(of(f"{path}/{folder}")))
    numbers = listed("generations")
    used = {s for n in numbers[-keep:] for s in spark.read.schema(_GENERATION).parquet(f"{path}/generations/{n}").first()["segments"]}
    stale = [s for s in listed("segments") if s not in used]
    for old in (*(f"generations/{n}" for n in numbers[:-keep]), *(f"segments/{s}" for s in stale)):
        fs.delete(of(f"{path}/{old}"), True)
    return len(stale)
