"""Scores of texts by a class-based n-gram model (Brown et al.): P(word | word before) = P(class | class before) P(word | class).

Exchange clustering assigns the words of the training texts to CLASSES classes: a word moves to the class that raises the
likelihood of the training texts most. Counts cover all training texts.

1. Chunks: texts are split into words once. A chunk (about CHUNK bytes of text) holds its distinct words' hashes and, for
   each word in order, its place among them. Chunks are written; all later passes read them.
2. Vocabulary: counts by hash, summed by Spark. A second hash tells whether two words share one; if so, all is done again
   with other hashes.
3. Exchange among frequent words, those with at least 1 of SHARE tokens (so at most SHARE words): Spark sums their pairs
   once; in each round tasks sum each word's neighbours by class, and each word finds its best class on its own. The most
   frequent words, one a class, stay where they are; the others move in the first round, then half of them in turn, as
   words that move together can spoil each other's gain. The likeliest of the ROUNDS + 1 assignments is taken.
4. Each rarer word moves once, to its best class among its frequent neighbours in all texts: rows (word, class of the
   neighbour, count), summed by Spark, so no word gathers more than 2 (CLASSES + 1) of them.
5. Each chunk asks for the classes and counts of its rarer words (a join by hash; no such word is hot) and turns its texts
   into pairs of classes with counts. Transitions are the sums of these; then each text is scored.

Frequent words, and matrices of CLASSES x CLASSES, are all that tasks are sent or the driver holds.

Smoothing: DELTA is added to the count of each word of a class and of an unknown one; a transition is mixed with the
class's own share as if seen CLASSES times. An unknown word may come from any class. A text ends with an end token, which
has class 0 to itself and stands before the first word. With nothing to learn from, every score is 0.

A null text counts as empty: its end is scored. A null id counts as the empty text for the choice of training rows. Every
row gives one row, repeated ones too, and repeated rows count as often as they stand; other columns are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, grouped, materialize, ready, words_of

CLASSES, ROUNDS, SHARE, DELTA = 64, 3, 1 << 18, 0.1
CHUNK = 16 << 20
#: Rows that a task gathers before it gives out sums, and rows of a matrix of CLASSES that numpy holds at once.
HELD, BLOCK = 1 << 21, 1 << 14

# --- chunks ---------------------------------------------------------------------------------------------------------


def _bytes(array: np.ndarray, kind: str) -> bytes:
    return array.astype(kind).tobytes()


_ZSTD = pa.Codec("zstd", 3)


def _squeezed(array: np.ndarray) -> bytes:
    """Numbers as zstd of their four byte planes, led by how many there are."""
    planes = np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(array).to_bytes(8, "little") + (_ZSTD.compress(planes, asbytes=True) if planes else b"")


def _unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(_ZSTD.decompress(data[8:], decompressed_size=4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _stored(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _chunks(size: int, turn: int):
    """Rows (doc_id, held, text) as chunks. A word's hash is never 0, which stands for the end."""

    def chunk(batch: pa.RecordBatch, texts: list[bytes], number: int) -> pa.RecordBatch:
        hashes, start, stop, begin = words_of(texts, lower=True)
        if turn:
            data = b"\n".join(texts).translate(_LOWER)
            hashes = np.array([xxhash.xxh3_64_intdigest(data[a:b], turn) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.uint64)
        known, first, stream = np.unique(np.maximum(hashes, 1), return_index=True, return_inverse=True)
        data = b"\n".join(texts)
        checks = np.array([xxhash.xxh3_64_intdigest(data[a:b].translate(_LOWER), 99) for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)], np.uint64)
        row = number, _stored(batch), _squeezed(np.diff(begin)), _bytes(known, "<u8"), _bytes(checks, "<u8"), _squeezed(stream)
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["chunk", "docs", "sizes", "words", "checks", "stream"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            docs = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            return chunk(docs, texts, number)

        for batch in batches:
            raw = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for a, b in grouped(raw, 1 << 20):
                rows.append(batch.select([0, 1]).slice(a, b - a))
                texts += raw[a:b]
                held += sum(map(len, raw[a:b]))
                if held >= size or len(texts) >= 1 << 16:
                    yield flush()
                    number, rows, texts, held = number + 1, [], [], 0
        if rows:
            yield flush()

    return go


CHUNKS = "chunk long, docs binary, sizes binary, words binary, checks binary, stream binary"


class Chunk:
    """The words of a chunk: `known` hashes (0, the end, first), and `tokens`, places among them, with an end behind each text."""

    def __init__(self, row: dict):
        self.row = row
        words = np.frombuffer(row["words"], "<u8")
        self.known = np.concatenate([[np.uint64(0)], words])
        sizes = _unsqueezed(row["sizes"])
        ends = np.cumsum(sizes + 1) - 1 if len(sizes) else sizes
        self.tokens = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        inner = np.ones(len(self.tokens), bool)
        inner[ends] = False
        self.tokens[inner] = _unsqueezed(row["stream"]) + 1
        self.sizes = sizes + 1
        self.begin = ends - sizes

    def docs(self) -> pa.RecordBatch:
        return pa.ipc.open_stream(self.row["docs"]).read_all().combine_chunks().to_batches()[0]

    def checks(self) -> np.ndarray:
        return np.concatenate([[np.uint64(0)], np.frombuffer(self.row["checks"], "<u8")])

    def learning(self) -> np.ndarray:
        """Which tokens stand in training texts."""
        return np.repeat(~self.docs().column(1).to_numpy(zero_copy_only=False).astype(bool), self.sizes)

    def before(self) -> np.ndarray:
        """The token before each; an end before the first of a text."""
        out = np.concatenate([[0], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        out[self.begin] = 0
        return out


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0])


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(codes, return_inverse=True)
    return known, np.bincount(at, weights=counts, minlength=len(known)).astype(np.int64)


class _Sums:
    """Codes with counts, summed when more than HELD are held; add() tells whether these should be given out."""

    def __init__(self):
        self.codes, self.counts, self.rows = [], [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> bool:
        self.codes.append(codes)
        self.counts.append(counts)
        self.rows += len(codes)
        if self.rows <= HELD:
            return False
        codes, counts = self.taken()
        self.codes, self.counts, self.rows = [codes], [counts], len(codes)
        return self.rows > HELD // 2

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = _summed(np.concatenate(self.codes), np.concatenate(self.counts))
        self.codes, self.counts, self.rows = [], [], 0
        return found


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns.values()], names=list(columns))


def _split(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


# --- vocabulary -----------------------------------------------------------------------------------------------------


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _opened(batches):
        n = np.bincount(chunk.tokens[chunk.learning()], minlength=len(chunk.known))
        yield from _split(_table(word=chunk.known, check=chunk.checks(), n=n))


class Frequent(NamedTuple):
    """The frequent words by number: the end has 0; `rank` is the place by count. All other words have the number len(words)."""

    words: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    order: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        by_hash = self.words[self.order]
        at = np.minimum(np.searchsorted(by_hash, hashes), len(by_hash) - 1)
        return np.where(by_hash[at] == hashes, self.order[at], len(by_hash))


def frequent_words(rows: list) -> Frequent:
    """Words and counts as given, the end first, then by count."""
    words, counts = np.array([r["word"] for r in rows] or [0], np.int64).view(np.uint64), np.array([r["n"] for r in rows] or [0], np.int64)
    first = np.lexsort((words, -counts, words != 0))
    words, counts = words[first], counts[first]
    return Frequent(words, counts, np.arange(len(words)), np.argsort(words))


# --- exchange -------------------------------------------------------------------------------------------------------


def phi(x: np.ndarray) -> np.ndarray:
    """x log x."""
    return x * np.log(np.maximum(x, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """The part of the training texts' log likelihood that depends on the classes."""
    return float(phi(matrix).sum() - phi(matrix.sum(0)).sum() - phi(matrix.sum(1)).sum())


def best_classes(own: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class to which each word best moves, and how much the log likelihood gains.

    `left` and `right` count each word's neighbours by class (one class more than words can have: that of the rarer
    words), without pairs of the word with itself; `matrix` counts pairs of classes. Class 0 is the end's alone.
    """
    size = len(matrix)
    gain = np.zeros((len(own), size))
    place = np.arange(len(own))
    for side, other, table in ((left, right, matrix), (right, left, matrix.T)):
        i, c = np.nonzero(side)
        for a in range(0, len(i), BLOCK):
            who, k = i[a : a + BLOCK], c[a : a + BLOCK]
            x = side[who, k].astype(np.float64)
            base = table[k].astype(np.float64)
            same = k == own[who]
            base[same] -= other[who[same]]  # what stands there now leaves with the word
            base[np.arange(len(who)), own[who]] -= x
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            gain[who[first]] += np.add.reduceat(phi(base + x[:, None]) - phi(base), first)
    loop = np.tile(np.diag(matrix).astype(np.float64), (len(own), 1))
    loop[place, own] -= left[place, own] + right[place, own]
    gain += phi(loop + left + right) - phi(loop + left) - phi(loop + right) + phi(loop)
    for total in (matrix.sum(0), matrix.sum(1)):
        rest = np.tile(total.astype(np.float64), (len(own), 1))
        rest[place, own] -= n
        gain -= phi(rest + n[:, None]) - phi(rest)
    gain[:, [0, size - 1]] = -np.inf
    best = gain.argmax(1)
    more = gain[place, best] - gain[place, own]
    return np.where(more > 1e-6, best, own), np.maximum(more, 0.0)


def _pairs(frequent):
    """Pairs of frequent words (all rarer ones as one) in training texts: before << 32 | after, n."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = frequent.value, _Sums()
        for chunk in _opened(batches):
            number = words.numbers(chunk.known)
            some = chunk.learning()
            code = number[chunk.before()[some]] << 32 | number[chunk.tokens[some]]
            if sums.add(*np.unique(code, return_counts=True)):
                pair, n = sums.taken()
                yield from _split(_table(pair=pair, n=n))
        pair, n = sums.taken()
        yield from _split(_table(pair=pair, n=n))

    return go


def _neighbours(classes, size: int):
    """What the pairs tell: (word, k, n), k the class before, or size + the class behind; word -1 - c: the matrix's row c."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, matrix = classes.value.astype(np.int64), _Sums(), np.zeros(size * size, np.int64)
        for batch in batches:
            pair, n = (batch.column(i).to_numpy() for i in (0, 1))
            a, b = pair >> 32, pair & 0xFFFFFFFF
            matrix += np.bincount(own[a] * size + own[b], weights=n, minlength=size * size).astype(np.int64)
            apart = a != b
            a, b, n = a[apart], b[apart], n[apart]
            codes, counts = _summed(np.concatenate([b << 16 | own[a], a << 16 | (size + own[b])]), np.concatenate([n, n]))
            rarer = codes >> 16 == len(own) - 1
            if sums.add(codes[~rarer], counts[~rarer]):
                code, n = sums.taken()
                yield from _split(_table(word=code >> 16, k=code & 0xFFFF, n=n))
        code, n = sums.taken()
        yield from _split(_table(word=code >> 16, k=code & 0xFFFF, n=n))
        cell = np.flatnonzero(matrix)
        yield _table(word=-1 - cell // size, k=cell % size, n=matrix[cell])

    return go


def _dense(rows: pa.ListArray, size: int) -> np.ndarray:
    """Lists of (k, n) as rows of 2 size counts."""
    out = np.zeros((len(rows), 2 * size), np.int64)
    flat, who = rows.flatten(), np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
    k, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    some = k >= 0
    out[who[some], k[some]] = n[some]
    return out


def _moved(frequent, classes, matrix: np.ndarray):
    """(word, class) of words (word, list of (k, n)) that move."""
    size = len(matrix)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = classes.value.astype(np.int64), frequent.value.counts
        for batch in batches:
            for part in _split(batch, 512):
                word = part.column(0).to_numpy()
                sides = _dense(part.column(1), size)
                best, _ = best_classes(own[word], counts[word], sides[:, :size], sides[:, size:], matrix)
                moves = best != own[word]
                yield _table(word=word[moves], **{"class": best[moves]})

    return go


def _listed(rows: DataFrame) -> DataFrame:
    """(word, found): what stands near each word, at most 2 (CLASSES + 1) + 1 entries of (k, n)."""
    return rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("found"))


def exchange(pairs: DataFrame, frequent, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each frequent word, with that of all rarer ones behind, and the counts of pairs of classes."""
    spark, words, size = pairs.sparkSession, frequent.value, classes + 1
    own = np.append(np.minimum(words.rank, classes - 1), classes).astype(np.uint16)
    best = (-np.inf, own, np.zeros((size, size), np.int64))
    for turn in range(rounds + 1):
        sent = spark.sparkContext.broadcast(own)
        told = materialize(pairs.mapInArrow(_neighbours(sent, size), "word long, k long, n long").groupBy("word", "k").agg(F.sum("n").alias("n")))
        matrix = np.zeros((size, size), np.int64)
        for r in told.where("word < 0").collect():
            matrix[-1 - r["word"], r["k"]] = r["n"]
        if likelihood(matrix) > best[0]:
            best = (likelihood(matrix), own, matrix)
        if turn < rounds and len(words.words) > classes:
            movers = told.where(F.col("word") >= classes)
            if turn:
                movers = movers.where(F.col("word") % 2 == turn % 2)
            own = own.copy()
            for r in _listed(movers).mapInArrow(_moved(frequent, sent, matrix), "word long, class long").toLocalIterator():
                own[r["word"]] = r["class"]
        forget(told)
    return best[1], best[2]


# --- rarer words ----------------------------------------------------------------------------------------------------


def _contexts(frequent, classes, size: int):
    """(word, k, n) of the rarer words of training texts: frequent neighbours by class, and k = -1: how often the word stands."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = frequent.value, classes.value.astype(np.int64)
        for chunk in _opened(batches):
            number = words.numbers(chunk.known)
            rarer, group = number == len(words.words), own[number]
            some = chunk.learning()
            after, before = chunk.tokens[some], chunk.before()[some]
            codes = [after[rarer[after]] << 16 | 0xFFFF]
            for word, near, shift in ((after, before, 0), (before, after, size)):
                apart = rarer[word] & ~rarer[near]
                codes.append(word[apart] << 16 | (group[near[apart]] + shift))
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            k = code & 0xFFFF
            yield from _split(_table(word=chunk.known[code >> 16], k=np.where(k == 0xFFFF, -1, k), n=n))

    return go


def _placed(matrix: np.ndarray):
    """(word, class, n) of words (word, list of (k, n)): the class in which the likelihood gains most."""
    size = len(matrix)
    cells = np.concatenate([matrix, matrix.T]).astype(np.float64)
    small = 8
    table = np.stack([phi(cells + x) - phi(cells) for x in range(1, small + 1)])
    total = matrix.sum(0).astype(np.float64)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _split(batch, 4096):
                found = part.column(1)
                flat, who = found.flatten(), np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
                k, x = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                n = np.zeros(len(found), np.int64)
                n[who[k < 0]] = x[k < 0]
                near = k >= 0
                who, k, x = who[near], k[near], x[near]
                gain = np.zeros((len(found), size))
                for a in range(0, len(who), BLOCK):
                    w, c, y = who[a : a + BLOCK], k[a : a + BLOCK], x[a : a + BLOCK]
                    rise = table[np.minimum(y, small) - 1, c]
                    many = np.flatnonzero(y > small)
                    rise[many] = phi(cells[c[many]] + y[many, None]) - phi(cells[c[many]])
                    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                    gain[w[first]] += np.add.reduceat(rise, first)
                gain -= 2 * (phi(total + n[:, None]) - phi(total))
                gain[:, [0, size - 1]] = -np.inf
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(gain.argmax(1)), pa.array(n)], names=["word", "class", "n"])

    return go


# --- scores ---------------------------------------------------------------------------------------------------------


def _asked(frequent):
    """(chunk, word) of the rarer words of each chunk."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = frequent.value
        for batch in batches:
            for chunk, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = np.frombuffer(known, "<u8")
                rarer = known[words.numbers(known) == len(words.words)]
                yield from _split(_table(chunk=np.full(len(rarer), chunk), word=rarer))

    return go


class Totals(NamedTuple):
    """Tokens and distinct words of the training texts, in all and by class."""

    tokens: int
    distinct: int
    by_class: np.ndarray
    words: np.ndarray

    def base(self, n: np.ndarray) -> np.ndarray:
        """The logarithm of the smoothed share of words that stand n times."""
        return np.log10((n + DELTA) / (self.tokens + DELTA * (self.distinct + 1)))

    def mass(self) -> np.ndarray:
        """What the words of each class, and an unknown one, share."""
        return self.by_class + DELTA * (self.words + 1)


def _told(frequent, classes, totals: Totals):
    """What is left of the texts of a chunk: counts, sums of logarithms, and pairs of classes with counts."""
    size = len(totals.by_class) + 1  # the last class: unknown words

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        words, own = frequent.value, classes.value.astype(np.int64)
        out = []
        for row in left.to_pylist():
            chunk = Chunk(row)
            number = words.numbers(chunk.known)
            group, n = own[number], np.append(words.counts, 0)[number]
            group[n == 0] = size - 1
            asked = np.ascontiguousarray(right["word"].to_numpy()).view(np.uint64)
            at = np.searchsorted(chunk.known, asked)
            group[at], n[at] = right["class"].to_numpy(), right["n"].to_numpy()
            base = totals.base(n)
            emission = np.where(n > 0, np.log10((n + DELTA) / totals.mass()[np.minimum(group, size - 2)]), 0.0)
            docs, tokens = chunk.docs(), chunk.tokens
            summed = lambda x: np.add.reduceat(x[tokens], chunk.begin) if len(tokens) else np.zeros(0)  # noqa: E731, B023
            doc = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
            pair, times = np.unique(doc * size * size + group[chunk.before()] * size + group[tokens], return_counts=True)
            edge = np.searchsorted(pair, np.arange(len(chunk.sizes) + 1) * size * size)
            pair %= size * size
            lists = lambda x, kind: pa.array([_bytes(x[a:b], kind) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())  # noqa: E731, B023
            columns = [*docs.columns, chunk.sizes, summed((n > 0).astype(np.int64)), summed(base), summed(emission), lists(pair, "<u2"), lists(times, "<u4")]
            out.append(pa.table(columns, names=["doc_id", "held", "n_tokens", "n_known", "base_score", "emission", "pairs", "times"]))
        return pa.concat_tables(out) if out else None

    return go


def _transitions(size: int):
    """Pairs of classes in training texts, summed by task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            pair, times = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind) for i, kind in ((0, "<u2"), (1, "<u4")))
            total += np.bincount(pair, weights=times, minlength=size * size).astype(np.int64)
        yield _table(pair=np.flatnonzero(total), n=total[total > 0])

    return go


def transition_logs(counts: np.ndarray, totals: Totals) -> np.ndarray:
    """Base-10 logarithms of P(class | class before); the last row and column are those of unknown words."""
    size = len(counts)
    own = (counts.sum(0) + 1) / (counts.sum() + size)
    p = (counts + size * own) / (counts.sum(1, keepdims=True) + size)
    p = np.vstack([p, own])
    unknown = p @ (DELTA / totals.mass())
    return np.log10(np.column_stack([p, unknown]))


def _scored(logs: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = logs.ravel()
        for whole in batches:
            for batch in _split(whole, 4096):
                pairs, times = (batch.column(i).to_pylist() for i in (6, 7))
                log = flat[np.frombuffer(b"".join(pairs), "<u2")] * np.frombuffer(b"".join(times), "<u4")
                begin = np.cumsum([0, *(len(x) // 2 for x in pairs[:-1])])
                score = batch.column(5).to_numpy() + np.add.reduceat(log, begin)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return go


class Model(NamedTuple):
    """What exchange clustering has learnt: frequent words with classes (both broadcast), the rarer words' table, totals."""

    frequent: object
    classes: object
    rarer: DataFrame
    totals: Totals


def _vocabulary_of(chunks: DataFrame) -> tuple[DataFrame, bool]:
    """(word, n) of all words, n in training texts, and whether a hash stands for two of them."""
    found = chunks.select("docs", "sizes", "words", "checks", "stream").mapInArrow(_vocabulary, "word long, check long, n long")
    found = materialize(found.groupBy("word").agg(F.sum("n").alias("n"), (F.min("check") != F.max("check")).alias("clash")))
    return found.drop("clash"), not found.where("clash").isEmpty()


def learn(chunks: DataFrame, vocabulary: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, share: int = SHARE) -> Model:
    """Cluster the words of the training texts of chunks."""
    spark: SparkSession = chunks.sparkSession
    tokens, distinct = vocabulary.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = vocabulary.where((F.col("word") == 0) | ((F.col("n") > 0) & (F.col("n") * share >= tokens)))
    frequent = spark.sparkContext.broadcast(frequent_words(frequent.collect()))
    words = frequent.value
    chunks = chunks.drop("chunk", "checks")
    pairs = chunks.mapInArrow(_pairs(frequent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs)
    own, matrix = exchange(pairs, frequent, classes, rounds)
    forget(pairs)
    sent = spark.sparkContext.broadcast(own)
    near = chunks.mapInArrow(_contexts(frequent, sent, classes + 1), "word long, k long, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))
    rarer = materialize(_listed(near).mapInArrow(_placed(matrix), "word long, class long, n long"))
    by_class, count = (np.bincount(own[:-1], weights=x, minlength=classes).astype(np.int64) for x in (words.counts, words.counts > 0))
    for r in rarer.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        by_class[r["class"]] += r["n"]
        count[r["class"]] += r["words"]
    return Model(frequent, sent, rarer, Totals(tokens, distinct, by_class, count))


def scored(chunks: DataFrame, model: Model, doc_id: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of the texts of chunks."""
    size = len(model.totals.by_class) + 1
    asked = chunks.select("chunk", "words").mapInArrow(_asked(model.frequent), "chunk long, word long")
    rarer = model.rarer
    if rarer.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rarer = F.broadcast(rarer)
    answers = asked.join(rarer, "word")
    told = chunks.drop("checks").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _told(model.frequent, model.classes, model.totals), f"doc_id {doc_id}, held boolean, n_tokens long, n_known long, base_score double, emission double, pairs binary, times binary"
    )
    told = materialize(told)
    counts = np.zeros((size, size), np.int64)
    for r in told.where("not held").select("pairs", "times").mapInArrow(_transitions(size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[divmod(r["pair"], size)] = r["n"]
    logs = transition_logs(counts[:-1, :-1], model.totals)
    return told.mapInArrow(_scored(logs), f"doc_id {doc_id}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column, of: int = 10) -> Column:
    """The rows that nothing is learnt from: 1 of so many ids, told by their CRC-32."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == 0


def chunked(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Written chunks of all texts, and the vocabulary, with hashes that tell all words apart."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), docs[text_col].alias("text"))
    turn = 0
    while True:
        chunks = materialize(rows.mapInArrow(_chunks(size, turn), CHUNKS))
        vocabulary, clash = _vocabulary_of(chunks)
        if not clash:
            return chunks, vocabulary
        forget(chunks)
        forget(vocabulary)
        turn += 1


def score(docs: DataFrame, held: Column | None = None, classes: int = CLASSES, rounds: int = ROUNDS, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, the model's log10 probability of each text."""
    ready(docs.sparkSession)
    held = held_out(docs[id_col]) if held is None else held
    chunks, vocabulary = chunked(docs, held, id_col, text_col)
    model = learn(chunks, vocabulary, classes, rounds, share)
    found = scored(chunks, model, docs.schema[id_col].dataType.simpleString())
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
