"""N-gram Jaccard join with several global token orders.

A document's tokens are the 64-bit hashes of its distinct five-word shingles. Two sets of similarity t or more share
a token among the first |x| - ceil(t |x|) + 1 tokens of x, and likewise of y, under any global order. So a pair must
share prefix tokens under each of several orders, which are intersected before the exact overlap is counted.

1. Documents with equal sets become one class: the least doc_id stands for it.
2. The order of the hashes themselves is known before anything is counted. Its prefixes, longer by EXTRA hundredths of the
   set, are dealt first, by 32 bits of each token within its range: of two similar sets, the extended prefixes share as many
   tokens more. A document that shares too few with all others together has no partner and drops out (equal bits of
   different tokens only keep documents), so that most texts send about three eighths of their tokens, once.
3. All tokens of the others are dealt by ranges of their hashes, packed in binary blocks of 6 bytes a token, and their
   document frequencies counted. A token that one document alone has can be in no overlap; only the others return to their
   documents. Tokens that take part in more than 1 of HOT (at most HOT of them) are found before, by counts combined in
   the tasks, and stay with their documents, so that no range holds a long list. Of very many ranges, tokens go to
   groups of ranges first and then on to their own.
4. Every order starts with the rarest tokens, with finer or coarser classes of frequency and with ties broken by
   hashes of their own. A document whose prefix holds unshared tokens only has no partner and drops out.
5. Documents gather around leaders: the least document with which one shares the most prefix tokens, or that one's
   leader. They are compared in blocks of bounded size, each of which holds the leader too; what does not link with
   the leader is compared with all of the block. So n near copies cost n comparisons and become one component.
6. Documents that are linked, directly or not, need not meet. A document goes to a larger block only if, under every order,
   it shares a prefix token with a document there in a different component: the filters of the orders are intersected
   before records move and before any overlap is counted. A block's own documents move once for each full part of such
   guests. Pairs of documents pass the filters of all orders as well.
   Blocks of one great group whose documents do not link still meet pair by pair (a 2048^2th of the pairs of its documents).
7. Links are joined into components by star rounds.

Tokens count as equal if 48 bits of their hashes are.

Null texts, empty texts and texts without words have no shingles and link with nothing; so do rows with a null
doc_id, whose component is null. A repeated row is returned as often as it occurs. Texts that share a doc_id are one
node, to which the links of each lead. Other columns are not looked at. An empty table gives an empty result. Ids
are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, grouped, keep_ids, materialize, mix, named, ready, scratch, small, words_of
from .components import components

WIDTH, PERCENT = 5, 75
#: A token is hot if it is more than 1 of HOT entries of all sets, or in HOT_LEAST of them if that is more. Tasks report what
#: occurs HOT_IN_FLUSH times among HOT_FLUSH tokens.
HOT, HOT_LEAST, HOT_IN_FLUSH, HOT_FLUSH = 1 << 18, 64, 4, 1 << 21
#: Tokens that a task gathers before it deals them out, and tokens of a range.
FLUSH, RANGE = 1 << 19, 1 << 20
#: By how many hundredths of a set its prefix in the order of the hashes is longer than needed.
EXTRA = 12
#: Bits of a range that are dealt in one step.
HOP = 12
#: Documents and tokens of a block.
BLOCK_DOCS, BLOCK_TOKENS = 2048, 1 << 20
#: Rows of meetings (five columns) that may be broadcast.
MET_ROWS = BROADCAST_ROWS // 4
#: Rows of a block that are compared at a time.
SLICE = 256
#: How often a document's leader is replaced by its leader's leader before blocks are formed.
HOPS = 3
#: The orders: by how much the classes of frequency (eighths of a power of two) are coarsened.
ORDERS = (1, 8, 24)
MASK = np.uint64((1 << 48) - 1)


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other; and where each text's begin."""
    words, _, _, begin = words_of(texts, lower=True)
    many = np.diff(begin)
    with np.errstate(over="ignore"):
        rolled = words.copy()
        for k in range(1, width):
            whole = max(0, len(words) - k)
            rolled[:whole] = mix(rolled[:whole] * np.uint64(31) + words[k:])
    out, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i, n in enumerate(many):
        if n >= width:
            x = rolled[begin[i] : begin[i + 1] - width + 1]
            x = np.sort(x)
            x = x[np.append(True, x[1:] != x[:-1])]
        elif n:
            with np.errstate(over="ignore"):
                whole = np.uint64(n)
                for w in words[begin[i] : begin[i + 1]]:
                    whole = mix(np.array([whole * np.uint64(37) + w]), 7)[0]
            x = np.array([whole], np.uint64)
        else:
            x = words[:0]
        out.append(x)
        sizes[i + 1] = len(x)
    return (np.concatenate(out) if out else words[:0]), np.cumsum(sizes)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]


def _summaries(width: int):
    """Rows of kind 0: id, size and 128-bit hash of each set; of kind 1: a token and in how many of a task's sets it is."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def hot() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= HOT_IN_FLUSH
            token, count = token[often], count[often]
            held.clear()
            return rows(1, pa.nulls(len(token), pa.int64()), count, token & MASK, token * np.uint64(0))

        def rows(kind: int, ids: pa.Array, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(n), kind, np.int32)), ids, *(pa.array(x.astype(np.int64)) for x in (n, a.view(np.int64), b.view(np.int64)))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "doc_id", "n", "k1", "k2"])

        for batch in small(batches):
            texts, size = _texts(batch), 0
            for first, last in grouped(texts):
                tokens, at = shingles(texts[first:last], width)
                ends = np.zeros((2, len(tokens) + 1), np.uint64)
                with np.errstate(over="ignore"):
                    for seed in (0, 1):
                        np.cumsum(mix(tokens, seed + 3), out=ends[seed, 1:])
                    a, b = (x[at[1:]] - x[at[:-1]] for x in ends)
                yield rows(0, batch.column(0).slice(first, last - first).cast(pa.int64()), np.diff(at), a, b)
                held.append(tokens)
                size += len(tokens)
                if sum(map(len, held)) >= HOT_FLUSH:
                    yield hot()
        if held:
            yield hot()

    return go


def planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the upper ones of small numbers compress to nothing."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def id_planes(sorted_ids: np.ndarray) -> bytes:
    """Sorted ids as steps from one to the next."""
    return planes(np.diff(sorted_ids, prepend=sorted_ids[:1] * 0), "<i8")


def ids_from(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<i8"))


PACKED = "part int, docs binary, sizes binary, at binary, high binary, low binary, class binary"
PACKED_TYPE = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in ("docs", "sizes", "at", "high", "low", "class"))])


def packed(part: np.ndarray, doc: np.ndarray, size: np.ndarray, token: np.ndarray, klass: np.ndarray | None) -> Iterator[list]:
    """One row for each part, of (document, size of its set, 48-bit token, class) entries."""
    order = np.lexsort((token, part)) if klass is None else np.lexsort((token, doc, part))
    part, doc, size, token = part[order], doc[order], size[order], token[order]
    klass = None if klass is None else klass[order]
    edge = np.append(np.flatnonzero(fresh(part)), len(part))
    for first, last in zip(edge[:-1], edge[1:], strict=True):
        docs, one, at = np.unique(doc[first:last], return_index=True, return_inverse=True)
        t = token[first:last]
        yield [int(part[first]), id_planes(docs), planes(size[first:last][one], "<u4"), planes(at, "<u2" if len(docs) <= 1 << 16 else "<u4"),
               (t >> np.uint64(32)).astype("<u2").tobytes(), t.astype("<u4").tobytes(), b"" if klass is None else klass[first:last].tobytes()]


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    docs, sizes = ids_from(row["docs"]), from_planes(row["sizes"], "<u4")
    at = from_planes(row["at"], "<u2" if len(docs) <= 1 << 16 else "<u4")
    token = np.frombuffer(row["high"], "<u2").astype(np.uint64) << np.uint64(32) | np.frombuffer(row["low"], "<u4")
    klass = np.frombuffer(row["class"], np.uint8) if row["class"] else np.zeros(len(at), np.uint8)
    return docs[at], sizes[at], token, klass


def _table(rows: list[list]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED_TYPE)], schema=PACKED_TYPE)


def fresh(*sorted_columns: np.ndarray) -> np.ndarray:
    """Of sorted rows: which differ from the one before."""
    out = np.zeros(len(sorted_columns[0]), bool)
    out[:1] = True
    for x in sorted_columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def run_lengths(x: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array, how often its value occurs."""
    edge = np.flatnonzero(fresh(x))
    count = np.diff(np.append(edge, len(x)))
    return np.repeat(count, count)


def frequency_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(count)).astype(np.uint8)


def _part(x: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The upper bits of numbers of that width."""
    return (x >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _spread(doc: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64), 5)


def extra(n: np.ndarray) -> np.ndarray:
    return EXTRA * n // 100


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of its extended prefix a set of n shares with that of any partner, which has percent of n tokens at least."""
    least = -(-percent * n // 100)
    return np.minimum(1 + extra(least), least)


COUNTED = "part int, docs binary, counts binary, sizes binary, tokens binary"
COUNTED_TYPE = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in ("docs", "counts", "sizes", "tokens"))])


def _counted(rows: list[list]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(COUNTED_TYPE)], schema=COUNTED_TYPE)


def _by_document(doc: np.ndarray, count: np.ndarray, size: np.ndarray | None, bits: int) -> Iterator[list]:
    """One row for each part of the documents, of the number of shared tokens and perhaps the size of each."""
    part = _part(_spread(doc), 64, bits)
    order = np.lexsort((doc, part))
    edge = np.append(np.flatnonzero(fresh(part[order])), len(part))
    for first, last in zip(edge[:-1], edge[1:], strict=True):
        own = order[first:last]
        yield [int(part[own[0]]), id_planes(doc[own]), planes(count[own], "<u4"), b"" if size is None else planes(size[own], "<u4"), b""]


def _prefixes(width: int, percent: int, bits: int, hot):
    """Extended prefixes in the order of the hashes by range of tokens; with a negative part, sizes and hot tokens' numbers of documents."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = hot.value[0]
        held: list[tuple] = []

        def flush() -> list[pa.RecordBatch]:
            doc, n, token = ([x[i] for x in held] for i in range(3))
            held.clear()
            token, at = np.concatenate(token), np.repeat(np.arange(sum(map(len, n))), np.concatenate([taken(x) for x in n]))
            doc, n = np.concatenate(doc), np.concatenate(n)
            told = np.zeros(len(doc), np.int64)
            if len(often):
                is_hot = often[np.minimum(np.searchsorted(often, token & MASK), len(often) - 1)] == token & MASK
                told = np.bincount(at[is_hot], minlength=len(doc))
                token, at = token[~is_hot], at[~is_hot]
            rows = [[-1 - part, *rest] for part, *rest in _by_document(doc, told, n, bits)]
            place = mix(token, 17)
            part, place = _part(place, 64, bits), (place & np.uint64(0xFFFFFFFF)).astype("<u4")
            order = np.lexsort((doc[at], part))
            part, at, place = part[order], at[order], place[order]
            edge = np.append(np.flatnonzero(fresh(part)), len(part))
            for first, last in zip(edge[:-1], edge[1:], strict=True):
                own = doc[at[first:last]]
                start = np.flatnonzero(fresh(own))
                rows.append([int(part[first]), id_planes(own[start]), planes(np.diff(np.append(start, len(own))), "<u4"), b"", place[first:last].tobytes()])
            pa.default_memory_pool().release_unused()
            return _counted(rows).combine_chunks().to_batches()

        def taken(n: np.ndarray) -> np.ndarray:
            return np.minimum(n, prefix_length(n, percent) + extra(n)) * (n > 0)

        size = 0
        for batch in small(batches):
            texts, ids = _texts(batch), batch.column(0).to_numpy(zero_copy_only=False)
            for first, last in grouped(texts):
                tokens, at = shingles(texts[first:last], width)
                n = np.diff(at)
                within = np.arange(len(tokens)) - np.repeat(at[:-1], n)
                tokens = tokens[within < np.repeat(taken(n), n)]  # sets are sorted by hash
                held.append((ids[first:last].astype(np.int64), n, tokens))
                size += len(tokens)
                if size >= 2 * FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return go


def _shared_counts(bits: int):
    """Of one range, how many tokens of each document another entry has as well, by part of the documents."""

    def go(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if not rows or rows[0]["part"] < 0:
            for row in rows:
                row["part"] = -1 - row["part"]
            return pa.Table.from_pylist(rows, COUNTED_TYPE)
        doc = np.concatenate([np.repeat(ids_from(r["docs"]), from_planes(r["counts"], "<u4")) for r in rows])
        token = np.concatenate([np.frombuffer(r["tokens"], "<u4") for r in rows])
        order = np.argsort(token)
        doc = np.sort(doc[order[run_lengths(token[order]) >= 2]])
        doc, count = np.unique(doc, return_counts=True)
        return _counted(list(_by_document(doc, count, None, bits)))

    return go


def _partnered(percent: int):
    """(doc_id, n) of those documents of one part that share as many tokens as one with a partner does."""

    def go(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        doc, at = np.unique(np.concatenate([ids_from(r["docs"]) for r in rows]), return_inverse=True)
        count = np.bincount(at, np.concatenate([from_planes(r["counts"], "<u4") for r in rows]), len(doc))
        sized = np.concatenate([np.full(len(r["docs"]) // 8, r["sizes"] != b"") for r in rows])
        size = np.concatenate([from_planes(r["sizes"], "<u4") for r in rows]).astype(np.int64)
        # Of several texts that share an id, all have to pass what the least needs.
        need = np.full(len(doc), np.iinfo(np.int64).max)
        np.minimum.at(need, at[sized], needed(size, percent))
        n = np.bincount(at[sized], size, len(doc)).astype(np.int64)
        kept = (n > 0) & (count >= need)
        return pa.table({"doc_id": doc[kept], "n": n[kept]})

    return go


def _dealt(width: int, bits: int, hot):
    """Packed rows by range of tokens; those of hot tokens have a negative part and their class with them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, often_class = hot.value
        held: list[tuple] = []

        def flush() -> list[pa.RecordBatch]:
            doc, size, token = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows = []
            if len(often):
                at = np.minimum(np.searchsorted(often, token), len(often) - 1)
                is_hot = often[at] == token
                rows += packed(-1 - _part(_spread(doc[is_hot]), 64, bits), doc[is_hot], size[is_hot], token[is_hot], often_class[at[is_hot]])
                doc, size, token = doc[~is_hot], size[~is_hot], token[~is_hot]
            rows += packed(_part(token, 48, bits), doc, size, token, None)
            pa.default_memory_pool().release_unused()
            return _table(rows).combine_chunks().to_batches()

        size = 0
        for batch in small(batches):
            texts, ids = _texts(batch), batch.column(0).to_numpy(zero_copy_only=False)
            for first, last in grouped(texts):
                tokens, at = shingles(texts[first:last], width)
                n = np.diff(at)
                held.append((np.repeat(ids[first:last], n).astype(np.int64), np.repeat(n, n), tokens & MASK))
                size += len(tokens)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return go


def _dealt_on(bits: int):
    """Rows of the first step dealt on to their own ranges, or to documents if they have classes already."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> list[pa.RecordBatch]:
            out = []
            for kind in (True, False):
                own = [r for r in held if (r["class"] != b"") == kind]
                if own:
                    doc, size, token, klass = (np.concatenate(x) for x in zip(*map(unpacked, own), strict=True))
                    part = _part(_spread(doc), 64, bits) if kind else _part(token, 48, bits)
                    out += packed(-1 - part if kind and own[0]["part"] < 0 else part, doc, size, token, klass if kind else None)
            held.clear()
            return _table(out).combine_chunks().to_batches()

        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (size >= FLUSH or (row["part"] < 0) != (held[0]["part"] < 0)):
                    yield from flush()
                    size = 0
                held.append(row)
                size += len(row["low"]) // 4
        if held:
            yield from flush()

    return go


def _in_steps(dealt: DataFrame, bits: int) -> DataFrame:
    """Rows that were dealt by the upper HOP bits, dealt by all bits where there are more."""
    if bits <= HOP:
        return dealt
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_dealt_on(bits), PACKED)


def _returned(bits: int):
    """From the entries of one range, those of tokens that two documents have, dealt by document with their class."""

    def go(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if not rows or rows[0]["part"] < 0:
            for row in rows:  # hot tokens go on as they are
                row["part"] = -1 - row["part"]
            return pa.Table.from_pylist(rows, PACKED_TYPE)
        doc, size, token, _ = (np.concatenate(x) for x in zip(*map(unpacked, rows), strict=True))
        order = np.argsort(token)
        order = order[run_lengths(token[order]) >= 2]
        order = order[np.lexsort((doc[order], token[order]))]
        doc, size, token = doc[order], size[order], token[order]
        once = fresh(token, doc)  # a repeated row counts once
        doc, size, token = doc[once], size[once], token[once]
        count = run_lengths(token)
        shared = count >= 2
        doc, size, token, klass = doc[shared], size[shared], token[shared], frequency_class(count[shared])
        return _table(list(packed(_part(_spread(doc), 64, bits), doc, size, token, klass)))

    return go


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of a set of n must hold one of any partner's."""
    return n - -(-percent * n // 100) + 1


def rank(token: np.ndarray, klass: np.ndarray, order: int) -> np.ndarray:
    """The place of tokens in the global order of that number: class of frequency, then a hash of its own."""
    return (klass // ORDERS[order]).astype(np.uint64) << np.uint64(56) | mix(token, 11 + order) >> np.uint64(8)


def _prefix_mask(doc: np.ndarray, n: np.ndarray, token: np.ndarray, klass: np.ndarray, order: int, percent: int) -> np.ndarray:
    """Of entries sorted by document: which are in their document's prefix; unshared tokens, first in every order, are not listed."""
    place = np.lexsort((rank(token, klass, order), doc))
    first = np.flatnonzero(fresh(doc))
    listed = np.diff(np.append(first, len(doc)))
    within = np.arange(len(doc)) - np.repeat(first, listed)
    left = prefix_length(n.astype(np.int64), percent) - (n.astype(np.int64) - np.repeat(listed, listed))
    mask = np.zeros(len(doc), bool)
    mask[place] = within < left
    return mask


RECORD = "doc_id long, n long, tokens binary, classes binary, prefixes array<array<long>>"
RECORD_TYPE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("classes", pa.binary()), ("prefixes", pa.list_(pa.list_(pa.int64())))])


def _records(percent: int):
    def go(table: pa.Table) -> pa.Table:
        doc, size, token, klass = (np.concatenate(x) for x in zip(*map(unpacked, table.to_pylist()), strict=True))
        order = np.lexsort((token, doc))
        order = order[fresh(doc[order], token[order])]
        doc, size, token, klass = doc[order], size[order], token[order], klass[order]
        masks = [_prefix_mask(doc, size, token, klass, order, percent) for order in range(len(ORDERS))]
        edge = np.append(np.flatnonzero(fresh(doc)), len(doc))
        kept = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if masks[0][a:b].any():
                t = token[a:b]
                kept.append((int(doc[a]), int(size[a]), t.astype("<u8").tobytes(), klass[a:b].tobytes(), [t[m[a:b]].astype(np.int64) for m in masks]))
        return pa.Table.from_arrays([pa.array([r[i] for r in kept], f.type) for i, f in enumerate(RECORD_TYPE)], schema=RECORD_TYPE)

    return go


def overlaps(token: np.ndarray, at: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    """How many tokens each of some rows shares with each of n documents; products of bounded matrices."""
    out = np.zeros((len(rows), n), np.float32)
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    told = np.unique(token[place[at] >= 0])
    if not len(told):
        return out
    column = np.minimum(np.searchsorted(told, token), len(told) - 1)
    own = told[column] == token
    at, column = at[own], column[own]
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    step = 1024
    for low in range(0, len(told), step):
        a, b = np.searchsorted(column, (low, low + step))
        dense = np.zeros((n, min(step, len(told) - low)), np.float32)
        dense[at[a:b], column[a:b] - low] = 1
        out += dense[rows] @ dense.T
    return out


class Block:
    """Documents that are compared with each other, or those of side 0 with those of side 1."""

    def __init__(self, rows: list[tuple], percent: int):
        ids, n, tokens, classes, self.side, component, lead = zip(*rows, strict=True)
        self.percent, self.ids, self.n, self.side = percent, ids, np.array(n, np.int64), np.array(self.side)
        tokens = [np.frombuffer(t, "<u8") for t in tokens]
        self.at = np.repeat(np.arange(len(ids)), [len(t) for t in tokens])
        self.token, klass = np.concatenate(tokens), np.frombuffer(b"".join(classes), np.uint8)
        size = self.n[self.at]
        self.prefixes = [m for m in (_prefix_mask(self.at, size, self.token, klass, order, percent) for order in range(len(ORDERS)))]
        self.component = np.unique(component, return_inverse=True)[1]
        self.lead = [i for i, x in enumerate(lead) if x]
        self.links: list[tuple[int, int]] = []

    def compare(self, rows: np.ndarray) -> None:
        """Link some rows with what they are similar to and not yet linked with."""
        for first in range(0, len(rows), SLICE):
            self._compare(rows[first : first + SLICE])

    def _compare(self, rows: np.ndarray) -> None:
        n = len(self.ids)
        low, high = np.minimum(self.n[rows, None], self.n), np.maximum(self.n[rows, None], self.n)
        passed = (self.component[rows, None] != self.component) & (low * 100 >= high * self.percent)
        if self.side.any():
            passed &= self.side[rows, None] != self.side
        for prefix in self.prefixes:
            live = passed.any(1)
            rows, passed = rows[live], passed[live]
            if not len(rows):
                return
            passed &= overlaps(self.token[prefix], self.at[prefix], n, rows) > 0
        live = passed.any(1)
        rows, passed = rows[live], passed[live]
        if not len(rows):
            return
        both = overlaps(self.token, self.at, n, rows).astype(np.int64)
        passed &= 100 * both >= self.percent * (self.n[rows, None] + self.n - both)
        for i, j in np.argwhere(passed):
            a, b = self.component[rows[i]], self.component[j]
            if a != b:
                self.component[self.component == b] = a
                self.links.append((int(self.ids[rows[i]]), int(self.ids[j])))

    def found(self) -> list[tuple[int, int]]:
        """Links that join whatever is linked."""
        for i in self.lead:
            self.compare(np.array([i]))
        if self.side.any():
            rows = np.flatnonzero(self.side == 0)
        else:
            rows = np.flatnonzero(self.component != self.component[self.lead[0]]) if self.lead else np.arange(len(self.ids))
        self.compare(rows)
        return self.links


def _verified(percent: int):
    """Links from rows sorted by meeting; one meeting is held at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def links() -> list[tuple[int, int]]:
            rows = [*dict.fromkeys(held)]
            return Block(rows, percent).found() if len(rows) > 1 else []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            found = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    found += links()
                    held.clear()
                    now = key
                held.append(tuple(row))
            yield out(found)
        yield out(links())

    return go


def _compared(met: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(u, v): links among documents that meet: rows (meeting, doc_id, side, component, lead)."""
    found, met = found.select("doc_id", "n", "tokens", "classes"), materialize(met)
    # Few meetings are broadcast; else only sets of documents that meet move to them.
    if met.count() <= MET_ROWS:
        met = F.broadcast(met)
    else:
        found = keep_ids(found, materialize(met.select("doc_id").distinct()), "doc_id", "left_semi")
    met = found.join(met, "doc_id").select("meeting", "doc_id", "n", "tokens", "classes", "side", "component", "lead")
    return met.repartition("meeting").sortWithinPartitions("meeting", "side", "doc_id").mapInArrow(_verified(percent), "u long, v long")


def _hot_tokens(summary: DataFrame, total: int):
    """The hot tokens and their classes, broadcast. The tasks' counts add up to `total` at most, so HOT tokens is the most."""
    rows = summary.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, total // HOT + 1)).toPandas()
    token, order = np.unique(rows["k1"].to_numpy(np.int64).astype(np.uint64), return_index=True)
    return summary.sparkSession.sparkContext.broadcast((token, frequency_class(np.maximum(2, rows["n"].to_numpy(np.int64)[order]))))


def _total(sized: DataFrame) -> int:
    return int(sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def partnered(docs: DataFrame, total: int, hot, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n) of documents (doc_id, text) that may have a partner by their prefixes in the order of the hashes; n adds up their sets' sizes."""
    sent = total * (100 - percent + EXTRA) // 100
    bits = min(31, (sent // (2 * RANGE)).bit_length())
    dealt = docs.mapInArrow(_prefixes(width, percent, bits, hot), COUNTED)
    counted = dealt.groupBy("part").applyInArrow(_shared_counts(bits), COUNTED)
    return counted.groupBy("part").applyInArrow(_partnered(percent), "doc_id long, n long")


def records(docs: DataFrame, summary: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of documents (doc_id, text) that may have a partner: their shared tokens, classes and prefix under each order."""
    total = _total(summary.where("kind = 0"))
    hot = _hot_tokens(summary, total)
    kept = materialize(partnered(docs, total, hot, width, percent))
    docs, total = keep_ids(docs, kept.select("doc_id"), "doc_id", "left_semi"), _total(kept)
    bits = min(31, (total // RANGE).bit_length())
    dealt = docs.mapInArrow(_dealt(width, min(bits, HOP), hot), PACKED)
    # Hot rows have negative parts, one for each part of the documents and sender.
    shared = _in_steps(dealt, bits).groupBy("part").applyInArrow(_returned(min(bits, HOP)), PACKED)
    return _in_steps(shared, bits).groupBy("part").applyInArrow(_records(percent), RECORD)


def blocks_of(found: DataFrame) -> DataFrame:
    """(doc_id, leader, block) of documents that share prefix tokens; a block is of bounded size."""
    postings = found.select("doc_id", F.explode(F.col("prefixes")[0]).alias("token"))
    leaders = postings.groupBy("token").agg(F.min("doc_id").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    best = postings.join(leaders, "token").groupBy("doc_id", "leader").count().groupBy("doc_id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    # Leaders of leaders gather what shares tokens step by step, such as many near copies, in few large blocks.
    best = materialize(best)
    for _ in range(HOPS):
        onward = best.select(F.col("doc_id").alias("leader"), F.col("leader").alias("onward"))
        after = materialize(best.join(onward, "leader", "left").select("doc_id", F.coalesce("onward", "leader").alias("leader")))
        forget(best)
        best = after
    sized = best.join(found.select("doc_id", "n"), "doc_id")
    parts = sized.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    blocks = materialize(best.join(parts, "leader").select("doc_id", "leader", F.xxhash64("leader", F.pmod(F.xxhash64("doc_id"), "parts")).alias("block")))
    forget(best)
    return blocks


def around_leaders(blocks: DataFrame) -> DataFrame:
    """Each block as one meeting, with its leader."""
    with_leader = blocks.select(F.col("leader").alias("doc_id"), "leader", "block").distinct()
    each = blocks.union(with_leader).groupBy("doc_id", "leader", "block").agg(F.lit(1))
    return each.select(F.col("block").alias("meeting"), "doc_id", F.lit(0).alias("side"), F.col("doc_id").alias("component"), (F.col("doc_id") == F.col("leader")).alias("lead"))


def across_components(found: DataFrame, blocks: DataFrame, joined: DataFrame) -> DataFrame | None:
    """Meetings of blocks with documents that share, under every order, prefix tokens across components; None if there are none."""
    labelled = found.select("doc_id", "n", "prefixes").join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "prefixes", F.coalesce("component", "doc_id").alias("component"))

    def across(postings: DataFrame) -> DataFrame:
        """Postings of tokens that documents of several components share under an order."""
        several = postings.groupBy("nth", "token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("nth", "token")
        return postings.join(several, ["nth", "token"])

    first = labelled.select("doc_id", "component", F.lit(0).alias("nth"), F.explode(F.col("prefixes")[0]).alias("token"))
    open_ = materialize(across(first).select("doc_id").distinct())
    if open_.isEmpty():
        forget(open_)
        return None
    each = labelled.join(open_, "doc_id").select("doc_id", "n", "component", F.posexplode("prefixes").alias("nth", "tokens"))
    blocks = blocks.select("doc_id", "block").join(blocks.groupBy("block").agg(F.count("*").alias("weight")), "block")
    live = across(each.select("doc_id", "n", "component", "nth", F.explode("tokens").alias("token"))).join(blocks, "doc_id")
    live = materialize(live)
    # Documents go to the larger blocks, so those of a great block do not go to each small one that shares a token with it.
    seen = live.groupBy("nth", "token", "block", "weight").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    seen = seen.withColumnsRenamed({"block": "other", "weight": "other_weight"})
    passed = live.join(seen, ["nth", "token"]).where("struct(weight, block) < struct(other_weight, other) and (least <> component or most <> component)")
    every = F.bit_or(F.expr("shiftleft(1, nth)")) == (1 << len(ORDERS)) - 1
    guests = passed.groupBy("doc_id", "n", "component", "other").agg(every.alias("every")).where("every").select("doc_id", "n", "component", F.col("other").alias("block"))
    guests = materialize(guests)
    # A block meets its guests in as many parts as keep each of bounded size.
    parts = guests.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    hosts = live.groupBy("doc_id", "component", "block").agg(every.alias("every")).where("every").join(parts, "block")
    hosts = hosts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block", "doc_id", F.lit(0).alias("side"), "component")
    guests = guests.join(parts, "block").select(F.expr("pmod(xxhash64(doc_id), parts)").alias("part"), "block", "doc_id", F.lit(1).alias("side"), "component")
    return hosts.union(guests).select(F.xxhash64("block", "part").alias("meeting"), "doc_id", "side", "component", F.lit(False).alias("lead"))


def labels(links: DataFrame) -> DataFrame:
    """(node, component) of linked nodes: the least around each, followed twice. Equal ones are linked; not all that are linked
    are equal yet, which only costs comparisons."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("component")))
    for _ in range(2):
        onward = now.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        after = materialize(now.join(onward, "component").select("node", F.col("onward").alias("component")))
        forget(now)
        now = after
    return now


def similar_links(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): links that join whatever is linked, of documents given by records()."""
    blocks = blocks_of(found)
    near = materialize(_compared(around_leaders(blocks), found, percent))
    met = across_components(found, blocks, labels(near))
    return near if met is None else near.union(materialize(_compared(met, found, percent)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links lead to) and class_id (the least with the same set)."""
    ready(docs.sparkSession)
    docs = named(docs, doc_id=id_col, text=text_col)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    with scratch() as keep:
        summary = materialize(docs.mapInArrow(_summaries(width), "kind int, doc_id long, n long, k1 long, k2 long"))
        rows = summary.where("kind = 0").drop("kind")
        classes = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("c")).where("c > 1").drop("c")
        small = classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        classed = rows.join(F.broadcast(classes) if small else classes, ["n", "k1", "k2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"))
        classed = keep(materialize(classed))
        copies = materialize(classed.where("doc_id <> class_id or n = 0").select("doc_id").distinct())
        found = materialize(records(keep_ids(docs.where("doc_id is not null"), copies, "doc_id", "left_anti"), summary, width, percent))
        # A doc_id on several rows with different texts is one node, so its classes are linked as well.
        several = classed.where("doc_id <> class_id").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
        twice = classed.groupBy("doc_id").agg(F.countDistinct("class_id").alias("c")).where("c > 1").select(F.col("doc_id").alias("u"))
        joined = keep(components(similar_links(found, percent).union(several.join(twice, "u", "left_semi"))))
    small = joined.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = F.broadcast(joined) if small else joined
    return classed.join(joined, classed["class_id"] == joined["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the least id.

    Rows that share a doc_id are one document and stay or go together. Rows without a doc_id link with nothing and stay.
    """
    with scratch() as keep:
        gone = near_duplicates(docs, id_col, text_col, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
        gone = keep(materialize(gone))
    return keep_ids(docs, gone, id_col, "left_anti")
