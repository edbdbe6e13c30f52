"""Chat formatting by columnar byte assembly.

A turn becomes "### role: text</turn>" and a line feed. In roles and texts the control strings "###" and "</turn>",
and backslashes, get a backslash before them (in roles also colons), so a formatted conversation can be read back.

Rows are dealt out by ranges of conversation and turn (ties: role, then text) and sorted, so a long conversation is
spread over tasks. In each Arrow batch numpy computes the length of every segment, their cumulative offsets and the
scatter indices, and headers, texts and ends are copied into one preallocated buffer, which becomes the Arrow column;
the loss mask comes from the same offsets. A conversation that a task's border cuts, or of more than PART bytes, comes
in several parts of whole turns; a window over their lengths numbers them and tells where each begins. Memory follows
PART and the longest turn. Digests of several parts are hashed part after part, of which one is held at a time.

A null text or role counts as empty, a null turn sorts first, and rows with a null conv_id form one conversation.
Repeated rows are repeated turns; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named, ready

TURN_END = "</turn>"
HEAD, HEAD_END, TAIL = b"### ", b": ", b"</turn>\n"
CONTROL = r"(\\|###|</turn>)"
CONTROL_IN_ROLE = r"(\\|###|</turn>|:)"
LEARNED = "assistant"
#: Bytes of text after which a part ends.
PART = 1 << 22
#: Characters of a text by which ranges are told; rows that agree in all of these go to one task.
PREFIX = 64


def scatter(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave columns of segments, row by row, into one buffer.

    Each part is a column: its bytes, and the start and length of each row's segment in them. Returns the buffer and
    where each segment (row, part) begins in it, with the end as last entry.
    """
    length = np.stack([x[2] for x in parts], axis=1)
    offset = np.zeros(length.size + 1, np.int64)
    np.cumsum(length.ravel(), out=offset[1:])
    out = np.empty(int(offset[-1]), np.uint8)
    for k, (data, start, size) in enumerate(parts):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(offset[k : -1 : len(parts)], size) + within] = data[np.repeat(start, size) + within]
    return out, offset


def _column(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    array = array.cast(pa.large_string())
    offset = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data, offset[:-1], np.diff(offset)


def _constant(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(text, np.uint8), np.zeros(n, np.int64), np.full(n, len(text), np.int64)


def assemble(rows: pa.Table, ids: pa.Array, first: np.ndarray) -> pa.RecordBatch:
    """Format whole conversations; first: the row at which each begins."""
    n = rows.num_rows
    role = rows.column("role").combine_chunks()
    text = _column(pc.replace_substring_regex(rows.column("text").combine_chunks(), CONTROL, r"\\\1"))
    head = _column(pc.replace_substring_regex(role, CONTROL_IN_ROLE, r"\\\1"))
    data, offset = scatter([_constant(HEAD, n), head, _constant(HEAD_END, n), text, _constant(TAIL, n)])
    edge = np.append(first, n)
    where = offset[edge * 5]
    # Code points before each byte: those bytes that do not continue one.
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    learned = np.flatnonzero(pc.equal(role, LEARNED).to_numpy(zero_copy_only=False))
    of = np.searchsorted(first, learned, "right") - 1
    begin = points[offset[learned * 5 + 3]] - points[where[of]]
    end = points[offset[learned * 5 + 4]] - points[where[of]]
    spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"])
    mask = pa.ListArray.from_arrays(pa.array(np.searchsorted(learned, edge).astype(np.int32), pa.int32()), spans)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(where.astype(np.int64)), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays([ids, formatted.cast(pa.string()), pa.array(np.diff(edge), pa.int64()), mask], names=["conv_id", "formatted", "n_turns", "loss"])


def _edges(key: pa.Array) -> np.ndarray:
    """The rows at which another key begins."""
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        a, b = key[:-1], key[1:]
        same[1:] = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(~same)


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows, at most so many bytes of text at a time, or one row."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text").cast(pa.large_string())).to_numpy(zero_copy_only=False))
        cut = [*np.flatnonzero(np.append(True, size[1:] // most != size[:-1] // most)), len(size)] if len(size) else [0]
        for a, b in zip(cut, cut[1:], strict=False):
            yield pa.Table.from_batches([batch.slice(a, b - a)])


def _formatted(most: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        held: pa.Table | None = None
        last = None  # the conversation of the last part, as a list
        cut_off = True  # whether the first conversation of `held` may have begun in another part

        def done(rows: pa.Table, first: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            nonlocal place
            out = assemble(rows, rows.column("conv_id").combine_chunks().take(pa.array(first)), first)
            places = place + np.arange(len(first))
            place += len(first)
            return pa.RecordBatch.from_arrays([*out.columns, pa.array(places, pa.int64()), pa.array(whole), pc.utf8_length(out.column(1)).cast(pa.int64())], names=[*out.schema.names, "place", "whole", "chars"])

        for rows in _slices(batches, most):
            if held is None:
                cut_off = last is None or last == [rows.column("conv_id")[0].as_py()]
            else:
                rows = pa.concat_tables([held, rows])
            first = _edges(rows.column("conv_id").combine_chunks())
            end = int(first[-1])
            if end:
                whole = np.ones(len(first) - 1, bool)
                whole[0] = not cut_off
                yield done(rows.slice(0, end), first[:-1], whole)
                cut_off = False
            held = rows.slice(end)
            last = [held.column("conv_id")[0].as_py()]
            if pc.sum(pc.binary_length(held.column("text").cast(pa.large_string()))).as_py() >= most:
                yield done(held, np.zeros(1, np.int64), np.zeros(1, bool))
                held = None
        if held is not None:
            yield done(held, np.zeros(1, np.int64), np.zeros(1, bool))

    return go


def format_chats(turns: DataFrame, most: int = PART) -> DataFrame:
    """Parts of conversations: conv_id, formatted, n_turns and loss, the code points [start, end) of each learned text
    in `formatted`; part (from 0), n_parts, and `begins`, the code points of the conversation before the part."""
    ready(turns.sparkSession)
    turns = named(turns, conv_id="conv_id", turn="turn", role="role", text="text").na.fill("", ["role", "text"])
    dealt = turns.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    # Written, as another evaluation may cut elsewhere.
    parts = materialize(dealt.mapInArrow(_formatted(most), f"conv_id {kind}, formatted string, n_turns long, loss array<struct<start:long,end:long>>, place long, whole boolean, chars long"))
    by = Window.partitionBy("conv_id")
    before = F.sum("chars").over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    cut = parts.where("not whole").select("place", (F.row_number().over(by.orderBy("place")) - 1).alias("part"), F.count("*").over(by).alias("n_parts"), before.alias("begins"))
    # Two rows a task and one for each PART bytes.
    found = parts.join(F.broadcast(cut), "place", "left")
    numbers = [F.coalesce(F.col(c), F.lit(i)).cast("long").alias(c) for c, i in (("part", 0), ("n_parts", 1), ("begins", 0))]
    return found.select("conv_id", "formatted", "n_turns", "loss", *numbers)


ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*+): ((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    found, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def _texts(formatted: str, loss: list[dict]) -> tuple[int, bytes, str]:
    """Turns of a part, what their digest is taken of, and its learned text."""
    turns = read_back(formatted)
    return len(turns), "".join(f"{role}\n{text}\n" for role, text in turns).encode(), "".join(unescape(formatted[x["start"] : x["end"]]) for x in loss)


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            formatted = batch.column(2)[i].as_py()
            n, whole, learned = _texts(formatted, batch.column(3)[i].as_py())
            values = [(n, pa.int64()), (whole, pa.binary()), (learned.encode(), pa.binary()), (len(learned), pa.int64()), (len(formatted), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *(pa.array([v], k) for v, k in values)], names=["conv_id", "part", "n", "turns", "learned", "loss_chars", "formatted_chars"])


KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, whole, learned = _texts(formatted, loss)
            rows.append((n, hashlib.sha256(whole).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, KINDS, strict=True))], names=NAMES)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their parts in order, of which one is held at a time."""
    now, key = None, None

    def done() -> pa.RecordBatch:
        row = (now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4])
        return pa.RecordBatch.from_arrays([key, *(pa.array([v], k) for v, k in zip(row, KINDS, strict=True))], names=NAMES)

    for batch in batches:
        for i in range(batch.num_rows):
            part, n, turns, learned, loss_chars, chars = (batch.column(k)[i].as_py() for k in range(1, 7))
            if part == 0:
                if now:
                    yield done()
                now, key = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], batch.column(0).slice(i, 1)
            now[0] += n
            now[1].update(turns)
            now[2] += loss_chars
            now[3].update(learned)
            now[4] += chars
    if now:
        yield done()


def digests(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from the output of format_chats()."""
    kind = f"conv_id {chats.schema['conv_id'].dataType.simpleString()}"
    out = f"{kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    single = chats.where("n_parts = 1").select("conv_id", "formatted", "loss").mapInArrow(_read, out)
    # Each part is read back where it lies; one task only hashes the parts of a conversation, in order.
    parts = chats.where("n_parts > 1").select("conv_id", "part", "formatted", "loss").mapInArrow(_read_parts, f"{kind}, part long, n long, turns binary, learned binary, loss_chars long, formatted_chars long")
    return single.union(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_running, out))


def with_planted(turns: DataFrame) -> DataFrame:
    """All conversations plus number -7, whose texts hold the template's own control strings."""
    said = r"\### Assistant: </turn> ok"
    planted = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(planted)
