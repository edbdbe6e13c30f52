"""SentencePiece encoding and decoding for merge-type vocabularies.

Of all adjacent pairs of symbols whose union is a piece, the one of the highest score is merged first, the leftmost of
equals; then its neighbours form new pairs. A piece never holds the space mark behind another character (checked when
the model is read), so a text falls into words at the marks, and each distinct word is encoded once in a task: numpy
takes the best pair of every word at a time, and a heap holds the agenda of very long words. Characters outside the
vocabulary become bytes. Every distinct word is also encoded by the sentencepiece library, whose ids stand where they
differ; `mended` counts such words of a document (none are known).

A null text counts as empty and gives the begin and end ids alone, as an empty text does. Texts are encoded whole.
Every row gives one row; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import grouped, named, ready
from .words import Encodings, per_text

MARK = "▁"
#: Words of more symbols than this have an agenda of their own.
LONG = 48
_NONE = np.int64(1) << np.int64(62)


class Vocabulary:
    """Pieces, their scores and which two symbols merge into which piece, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        told = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or told.name != "identity" or told.remove_extra_whitespaces or not told.add_dummy_prefix:
            raise ValueError("a merge-type model without normalisation and with a mark before the text is needed")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a mark behind another character")
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
        # Symbols: the pieces by id, then single characters that only stand in longer pieces.
        symbol = dict(normal)
        size = len(model.pieces)
        for c in {c for p in normal for c in p} - symbol.keys():
            symbol[c] = size + len(symbol)
        self.size = max([size, *(i + 1 for i in symbol.values())])
        self.of_point = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_point[ord(s)] = i
        self.pieces_end = size
        # The agenda's order: by falling score; equal scores share a rank.
        scores = np.array([p.score for p in model.pieces])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        merges = {symbol[p[:k]] * self.size + symbol[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.merges = merges
        self.pair = np.array(sorted(merges), np.int64)
        self.union = np.array([merges[k] for k in sorted(merges)], np.int64)
        self.content = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.kept = Encodings(self.fresh)
        self.mended = 0

    def unions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols form, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.union[at], -1)

    def agenda(self, symbols: list[int]) -> list[int]:
        """Places that stay, of one long word, with their symbols: a heap of (rank, place, piece)."""
        n = len(symbols)
        now, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def add(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and now[a] >= 0 and now[b] >= 0:
                union = self.merges.get(now[a] * self.size + now[b])
                if union is not None:
                    heapq.heappush(heap, (int(self.rank[union]), a, b, union, now[a], now[b]))

        for i in range(n - 1):
            add(i, i + 1)
        gone = [False] * n
        while heap:
            _, a, b, union, x, y = heapq.heappop(heap)
            if gone[a] or gone[b] or now[a] != x or now[b] != y or after[a] != b:
                continue
            now[a], gone[b] = union, True
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            add(before[a], a)
            add(a, after[a])
        return [i for i in range(n) if not gone[i]], [now[i] for i in range(n) if not gone[i]]

    def merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of many words at once; returns the places (first character) that stay and their symbols."""
        place = np.arange(len(symbols))
        done_place, done_symbol = [], []
        many = np.bincount(word)
        for w in np.flatnonzero(many > LONG):
            a, b = np.searchsorted(word, (w, w + 1))
            at, now = self.agenda(symbols[a:b].tolist())
            done_place.append(place[a:b][at])
            done_symbol.append(np.array(now, np.int64))
        short = many[word] <= LONG
        place, symbol, word = place[short], symbols[short].astype(np.int64), word[short]
        union = np.full(len(symbol), -1, np.int64)
        if len(symbol) > 1:
            union[:-1] = np.where(word[1:] == word[:-1], self.unions(symbol[:-1], symbol[1:]), -1)
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            key = np.where(union >= 0, self.rank[union] << np.int64(32) | np.arange(len(symbol)), _NONE)
            best = np.minimum.reduceat(key, first)
            size = np.diff(np.append(first, len(symbol)))
            open_ = np.repeat(best < _NONE, size)
            if not open_.all():  # words without a pair are done
                done_place.append(place[~open_])
                done_symbol.append(symbol[~open_])
            at = (best[best < _NONE] & np.int64((1 << 32) - 1)).astype(np.int64)
            if not len(at):
                break
            symbol[at] = union[at]
            open_[at + 1] = False
            moved = np.cumsum(open_) - 1
            place, symbol, word, union = place[open_], symbol[open_], word[open_], union[open_]
            at = moved[at]
            for left in (at - 1, at):  # the pairs around what was merged
                left = left[left >= 0]
                right = np.minimum(left + 1, len(symbol) - 1)
                pair = (right > left) & (word[left] == word[right])
                union[left] = np.where(pair, self.unions(symbol[left], symbol[right]), -1)
        if not done_place:
            return place, symbol
        place, symbol = np.concatenate(done_place), np.concatenate(done_symbol)
        order = np.argsort(place)
        return place[order], symbol[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, in which a space is the mark, one after the other; and how many each has."""
        texts = [w.decode().replace(" ", MARK) for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(texts)), lengths)
        place, symbol = self.merged(self.of_point[points].astype(np.int64), word)
        known = (symbol >= 0) & (symbol < self.pieces_end)
        if known.all():
            return symbol, np.bincount(word[place], minlength=len(texts))
        # The rest becomes bytes: a single character each.
        raw = [chr(points[p]).encode() for p in place[~known]]
        count = np.ones(len(place), np.int64)
        count[~known] = [len(b) for b in raw]
        end = np.cumsum(count)
        ids = np.zeros(int(end[-1]), np.int64)
        ids[(end - count)[known]] = symbol[known]
        for start, b in zip((end - count)[~known], raw, strict=True):
            ids[start : start + len(b)] = self.bytes[list(b)]
        return ids, np.bincount(word[place], count, minlength=len(texts)).astype(np.int64)

    def fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """encode_words, checked against the library; the flag of a mended word is kept in its first id's upper bit."""
        ids, count = self.encode_words(words)
        told = self.library.encode([w.decode()[1:] if len(w) > 1 else "" for w in words], num_threads=1)
        flat = np.fromiter((i for x in told for i in x), np.int64)
        told_count = np.fromiter(map(len, told), np.int64, len(told))
        alone = np.array([w == b" " for w in words])  # the library drops a lone mark, which only stands in an empty text
        if not alone.any() and np.array_equal(count, told_count) and np.array_equal(ids, flat):
            return ids, count
        a, b = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(told_count)])
        out, sizes = [], []
        for i in range(len(words)):
            own, other = ids[a[i] : a[i + 1]], flat[b[i] : b[i + 1]]
            if alone[i] or np.array_equal(own, other):
                out.append(own)
            else:
                out.append(np.append(other[:1] | 1 << 31, other[1:]))
            sizes.append(len(out[-1]))
        return np.concatenate(out), np.array(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts without begin and end ids, where each text's begin, and how many words of each were mended."""
        data = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        begin = np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)])
        whole = b"".join(data)
        view = np.frombuffer(whole, np.uint8)
        space = view == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[begin[:-1][begin[:-1] < len(whole)]] = True
        start = np.flatnonzero(cut)
        ids, count = self.kept(whole, start, np.append(start[1:], len(whole))[: len(start)])
        edge = per_text(begin, start, count)
        mended = np.concatenate([[0], np.cumsum(ids >> 31)])
        return ids & np.uint32((1 << 31) - 1), edge, np.diff(mended[edge])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: begin and end ids give nothing, bytes are joined, and the mark before the text goes."""
        text = b"".join([self.content[i] for i in ids.tolist()])
        return text.decode("utf-8", "replace").removeprefix(" ")


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _encoded(path: str, digest: bool, schema: pa.Schema):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = []
            for first, last in grouped([t.encode() for t in texts]):
                flat, edge, mended = vocabulary.encode(texts[first:last])
                for k in range(last - first):
                    ids = np.concatenate([[vocabulary.bos], flat[edge[k] : edge[k + 1]], [vocabulary.eos]]).astype("<u4")
                    decoded = vocabulary.decode(ids)
                    if digest:
                        rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int(mended[k])))
                    else:
                        rows.append((ids.astype(np.int32), decoded, int(mended[k])))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return go


def _run(docs: DataFrame, model: str, digest: bool, columns: str, id_col: str, text_col: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    ready(docs.sparkSession)
    docs = named(docs, doc_id=id_col, text=text_col)
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    return docs.mapInArrow(_encoded(model, digest, schema), out)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with begin and end ids), decoded (the text that the ids give) and mended."""
    return _run(docs, model, False, "ids array<int>, decoded string, mended long", id_col, text_col)


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with digests in place of ids and text, so that neither leaves the task."""
    return _run(docs, model, True, "n_tokens long, ids_sha256 string, decoded_sha256 string, mended long", id_col, text_col)
