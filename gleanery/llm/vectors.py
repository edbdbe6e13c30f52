"""Product codes of vectors, nearest entries found by annular norm pruning.

Components become integers, floor(SCALE * x), and each vector is cut into PARTS equal parts. Each part position has a
codebook: first the parts of the ENTRIES smallest kept ids, then, ROUNDS times, the floor of the mean of the parts that
are nearest to an entry. Sums are taken by Spark from what each task has added up; only codebooks (PARTS x ENTRIES
entries, whatever the number of rows) come to the driver.

The nearest entry of a part: entries are sorted by norm. The entry next in norm gives a first distance d; by the triangle
inequality no entry whose norm differs by more than d is nearer, so a binary search cuts the annulus of norms within d,
borders included, and only its entries are measured, exactly, in integers. Ties go to the lower index.

Rows whose vector is null or holds null or non-finite components are dropped, as are vectors of another length than the
kept row with the smallest id has. A length that PARTS does not divide raises an error. Components count as at most
`bound(length)` in size, so that squared distances fit 64 bits (2^27, or 524,288 before scaling, for 64 components).
A null id sorts last; of rows that share an id, the smaller vector comes first. Repeated rows are repeated; null labels
form one group; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, named, ready

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Pairs of part and entry that are measured at once.
MEASURED = 1 << 20
#: Labels with more than 1 of so many rows are joined by broadcast when labels are too many to broadcast all.
LARGE = 1024


def bound(length: int) -> int:
    """The largest size of a component with which the squared distance of two vectors stays below 2^62."""
    return 1 << (60 - max(1, length - 1).bit_length()) // 2


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of rows of components."""
    most = bound(vectors.shape[1])
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -most, most).astype(np.int64)


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index and the squared distance of the entry nearest to each part."""
        norms = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        at = np.searchsorted(self.norms, norms)
        before = np.maximum(at - 1, 0)
        at = np.minimum(at, len(self.norms) - 1)
        start = np.where(np.abs(self.norms[before] - norms) < np.abs(self.norms[at] - norms), before, at)
        reach = np.sqrt(((parts - self.entries[self.order[start]]) ** 2).sum(1).astype(np.float64))
        slack = 1e-9 * (norms + reach) + 1e-6  # what rounding can take; a wider annulus loses nothing
        low = np.searchsorted(self.norms, norms - reach - slack, "left")
        count = np.searchsorted(self.norms, norms + reach + slack, "right") - low
        index, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        done = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(parts):
            b = max(a + 1, int(np.searchsorted(done, done[a] + MEASURED, "right")) - 1)
            some = count[a:b]
            begin = done[a:b] - done[a]
            entry = self.order[np.arange(int(some.sum())) + np.repeat(low[a:b] - begin, some)]
            distance = ((np.repeat(parts[a:b], some, axis=0) - self.entries[entry]) ** 2).sum(1)
            error[a:b] = np.minimum.reduceat(distance, begin)
            index[a:b] = np.minimum.reduceat(np.where(distance == np.repeat(error[a:b], some), entry, len(self.order)), begin)
            a = b
        return index, error


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (vector first) with their integer parts, and the index and squared distance of each part's entry."""
    tables = [Codebook(b) for b in books]
    count, _, width = books.shape
    for whole in batches:
        for a in range(0, whole.num_rows, 4096):
            batch = whole.slice(a, 4096)
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            parts = integers(flat.reshape(batch.num_rows, count * width)).reshape(batch.num_rows, count, width)
            found = [t.nearest(parts[:, p]) for p, t in enumerate(tables)]
            yield batch, parts, np.stack([i for i, _ in found], 1), np.stack([e for _, e in found], 1)


def _summed(books: np.ndarray):
    """For each part and entry of a task: how many parts it has, and the sum of each component."""
    count, entries, width = books.shape

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((count, entries, width), np.int64), np.zeros((count, entries), np.int64)
        for _, parts, index, _ in _assigned(batches, books):
            for p in range(count):
                rows[p] += np.bincount(index[:, p], minlength=entries)
                np.add.at(sums[p], index[:, p], parts[:, p])
        part, entry = np.nonzero(rows)
        place = np.tile(np.arange(width), len(part))
        part, entry = np.repeat(part, width), np.repeat(entry, width)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (part, entry, place, rows[part, entry], sums[part, entry, place])], names=["part", "entry", "place", "rows", "total"])

    return go


def _coded(books: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, index, error in _assigned(batches, books):
            code = [bytes(row).hex() for row in index.astype(np.uint8)] if books.shape[1] <= 256 else ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(code, pa.string()), pa.array(error.sum(1))], names=["vec_id", "label", "code", "error"])

    return go


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(vector, vec_id, label) of the rows that count, and their length (0 if there are none)."""
    rows = named(vectors, vector=vector_col, vec_id=id_col, label=label_col).withColumn("vector", F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & finite)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    length = first[0] if first else 0
    return rows.where(F.size("vector") == length), length


def codebooks(kept: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The entries of all part positions: parts x entries x length of a part."""
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = integers(np.array([r[0] for r in first], np.float64).reshape(len(first), length))
    books = np.ascontiguousarray(start.reshape(len(first), parts, length // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        told = kept.mapInArrow(_summed(books), "part long, entry long, place long, rows long, total long")
        means = told.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows")).collect()
        books = books.copy()
        for r in means:
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["rows"]
    return books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Each row with the sum of the errors of its label; null if that does not fit 64 bits."""
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("rows"))
    sums = sums.select(F.col("label").alias("of"), F.col("total").try_cast("long").alias("label_error"), "rows")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(sums), same, "left").drop("of", "rows")
    most = coded.count() // LARGE
    large = F.broadcast(sums.where(F.col("rows") > most))
    others = coded.join(large, same, "left_anti").join(sums.where(F.col("rows") <= most), same, "left")
    return coded.join(large, same).unionByName(others).drop("of", "rows")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of the kept rows, and the codebooks that the codes refer to."""
    ready(vectors.sparkSession)
    kept, length = kept_vectors(vectors, id_col, vector_col, label_col)
    books = codebooks(kept, length, parts, entries, rounds)
    kinds = {c: vectors.schema[s].dataType.simpleString() for c, s in (("vec_id", id_col), ("label", label_col))}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    coded = kept.mapInArrow(_coded(books), schema) if books.shape[1] else vectors.sparkSession.createDataFrame([], schema)
    return with_label_error(materialize(coded)), books


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the kept rows of a table (vec_id, embedding, label)."""
    coded, books = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
