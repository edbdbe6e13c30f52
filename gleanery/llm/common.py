"""What the ten operators share: session set-up, written tables, sized broadcasts and word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table of ids, in rows, that may be broadcast (8 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

#: White space and what is not, as the contracts of these operators define words.
WHITE = r"[\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package (a cluster gets it by --py-files or an image)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; an own one only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gleanery-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_WRITTEN: list[list[DataFrame]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(written)
    return written


def forget(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables that materialize() wrote inside, but for those given to the function it yields."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _WRITTEN.append([])
    try:
        yield keep
    finally:
        for df in _WRITTEN.pop():
            if not any(df is k for k in kept):
                forget(df)
        if _WRITTEN:
            _WRITTEN[-1].extend(kept)


def fresh_names(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of a table has (Spark does not tell capitals from small letters)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_ids(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of whole documents with a written one-column table of ids.

    Up to BROADCAST_ROWS ids are broadcast, so that the documents do not move; more are shuffled.
    """
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    (other,) = fresh_names(docs, "id")
    ids = ids.select(F.col(ids.columns[0]).alias(other))
    return docs.join(F.broadcast(ids) if small else ids, F.col(key) == F.col(other), how)


def named(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed, so that other columns cannot clash."""
    return docs.select(*(docs[source].alias(name) for name, source in columns.items()))


# --- word hashes ---------------------------------------------------------------------------------------------------

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes up to which numpy hashes pieces, eight bytes at a time; longer ones go through xxhash one by one.
SHORT_PIECE = 64
#: Which bytes of eight count, by how many are left of a piece.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; each seed gives another order of the same hashes."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0xD1B54A32D192ED03 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def piece_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces [start, stop) of bytes: each eight bytes are mixed into the hash so far."""
    size = stop - start
    out = mix(size.astype(np.uint64), 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= SHORT_PIECE))
    done = 0
    while len(live):
        left = size[live] - done
        out[live] = mix(out[live] ^ (eight[start[live] + done] & _LEFT[np.minimum(left, 8)]), 2)
        live = live[left > 8]
        done += 8
    long = np.flatnonzero(size > SHORT_PIECE)
    if len(long):
        view = memoryview(data)
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
    return out


def word_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (byte offsets) of each word of UTF-8 bytes; with lower, A-Z count as a-z."""
    padded = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=padded[1:-1])
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    start, stop = edge[0::2], edge[1::2]
    return piece_hashes(_LOWERED[data] if lower else data, start, stop), start, stop


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def grouped(texts: list[bytes], most: int = 1 << 21):
    """Runs (first, last) of texts of about `most` bytes together, so that what numpy holds at once is bounded."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes of several texts at once, and where each text's words begin (one entry more than texts).

    Starts and ends count from the beginning of the texts joined by one line feed.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    hashes, start, stop = word_hashes(data, lower)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return hashes, start, stop, np.searchsorted(start, begin)
