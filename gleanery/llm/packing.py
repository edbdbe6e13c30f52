"""Packing by power-of-two decomposition.

A document is its token ids and one end-of-document id. It is cut into as many pieces of `limit` ids as fit and then
into the powers of two that make up the rest, largest first. Pieces of one length form a bucket, and each piece is a
sequence of its own: no sequence crosses documents and none needs padding. `limit` is a power of two.

Pieces are written, dealt into their buckets (parts of about PART pieces, by content) and numbered there in the order of
document, start and ids. So a sequence_id tells bucket, part and place, and does not depend on how the input was
partitioned or on retries. Equal rows are interchangeable. write_buckets() stores one folder for each length.

A null or empty text gives one piece with the end id alone. Every row gives its own pieces (repeated rows too), other
columns are not looked at, and an empty table gives an empty result. Long texts are tokenised whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named, ready
from .letters import byte_letters

#: GPT-2's split pattern, as the pre-tokenizer of byte-level vocabularies applies it. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_ENCODINGS: dict = {}


def encoding(path: str):
    """The byte-level BPE of a tokenizers file as a tiktoken encoding: the same ids, made several times faster."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[path]


def piece_lengths(n: int, limit: int) -> list[int]:
    """`limit` as often as it fits, then the binary digits of the rest, largest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(path: str, limit: int, end_id: int, schema: pa.Schema):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoding(path), _narrow(path)
        for batch in (b.slice(first, ROWS) for b in batches for first in range(0, b.num_rows, ROWS)):
            at, starts, lengths, totals, chunks = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                data, start = np.append(encode.encode_to_numpy(value.as_py() or "", allowed_special="all"), np.uint32(end_id)).astype(kind), 0
                for length in piece_lengths(len(data), limit):
                    at.append(i)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(len(data))
                    chunks.append(data[start : start + length].tobytes())
                    start += length
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(chunks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return go


#: Pieces of one part of a bucket, on average.
PART = 1 << 12
#: Rows that a task turns at a time.
ROWS = 256


def _narrow(path: str) -> str:
    """The least unsigned type that holds all ids of a vocabulary; so pieces move."""
    return "<u2" if encoding(path).n_vocab <= 1 << 16 else "<u4"


def _widened(kind: str, at: int):
    """Ids as 32-bit integers again."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                wide = pa.array([np.frombuffer(x, kind).astype("<u4").tobytes() for x in part.column(at).to_pylist()], pa.binary())
                yield part.set_column(at, batch.schema.field(at), wide)

    return go


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length (also the bucket), doc_tokens, ids, sequence_id, offset.

    ids: little-endian unsigned 32-bit. sequence_id is unique: the exponent of the length, part, and place in 30 bits;
    offset is 0, as each sequence holds one piece.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    ready(docs.sparkSession)
    docs = named(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    pieces = docs.mapInArrow(_pieces(tokenizer, limit, end_id, arrow), schema)
    pieces = materialize(pieces)
    parts = 1 << max(0, (pieces.count() // PART).bit_length())
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids"))
    number = F.shiftleft(F.log2("length").cast("long"), 58) + F.shiftleft(F.col("part"), 30) + place
    numbered = pieces.withColumn("sequence_id", number).drop("part")
    numbered = numbered.mapInArrow(_widened(_narrow(tokenizer), numbered.columns.index("ids")), numbered.schema)
    return numbered.withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces of pack(), one folder for each length."""
    pieces.write.partitionBy("length").parquet(path)


def digests(pieces: DataFrame, *more: str) -> DataFrame:
    """The contract's columns, from the pieces of pack(), and what else is asked for."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)
