"""Token counts by compiled finite-state transducers, for merge vocabularies with word ends.

Two deterministic transducers stand behind each other. The first reads classes of characters and tells where words
begin, as the split pattern of the vocabulary does. Its texts are cut into chunks of equal length; the map of states of
every chunk (from each state in which it may be entered to the state in which it is left) is computed for all chunks
at once, the maps compose through a parallel prefix scan, and a second reading from the states so found emits.

The second reads the bytes of a word. Its states are what the encoding of later bytes can depend on: the bytes that
may still begin a token, the last token before each of them, and the tokens emitted between. Each transition is
annotated with the change of the number of tokens so far; the chunks of a long word become maps of (state, count),
which compose through the same scan. The transducer is compiled as far as texts need it, kept
for later batches of a task and dropped beyond KEPT transitions. A token may follow another exactly if the two
together encode to these two, which is decided once for each pair.

A null text counts as empty and has no tokens. Texts are read whole; every row gives one row; other columns are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import grouped, named, ready
from .letters import byte_letters, categories, code_points, unassigned
from .words import Encodings

#: Transitions that a task keeps, and characters of a chunk.
KEPT, CHUNK = 1 << 22, 256
#: Bytes from which a word is counted by chunks.
LONG_WORD = 2 * CHUNK
#: The split pattern of word-end vocabularies, which the first transducer compiles. Fixed value.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Classes of characters: white space, number, other, apostrophe, one of "stmd", one of "rv", "l", "e", other letter.
SPACE, NUMBER, OTHER, APOSTROPHE, SHORT, PENDING, ELL, EE, LETTER = range(9)
# States: nothing open, in letters, in others, behind a number, behind an apostrophe that begins a word, behind "'r" or
# "'v", behind "'l", behind a whole contraction.
START, LETTERS, OTHERS, NUMBERS, QUOTE, QUOTE_R, QUOTE_L, CLOSED = range(8)
#: What a transition emits: a word begins here, and a word began at the character before.
HERE, BEFORE = 1, 2


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and what is emitted."""
    if state == QUOTE and kind == SHORT:
        return CLOSED, 0
    if state == QUOTE and kind == PENDING:
        return QUOTE_R, 0
    if state == QUOTE and kind == ELL:
        return QUOTE_L, 0
    if state == QUOTE_R and kind == EE or state == QUOTE_L and kind == ELL:
        return CLOSED, 0
    late = BEFORE if state in (QUOTE_R, QUOTE_L) else 0  # the letter behind the apostrophe was a word's first after all
    inside = LETTERS if late else OTHERS if state == QUOTE else state
    if kind == SPACE:
        return START, late
    if kind == NUMBER:
        return NUMBERS, HERE | late
    if kind == OTHER:
        return OTHERS, late | (0 if inside == OTHERS else HERE)
    if kind == APOSTROPHE:
        return (OTHERS, late) if inside == OTHERS else (QUOTE, HERE | late)
    return LETTERS, late | (0 if inside == LETTERS else HERE)


NEXT = np.array([[_step(s, k)[0] for k in range(9)] for s in range(8)], np.uint8)
EMIT = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)], np.uint8)


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _CLASSES:
        table = np.array([OTHER, LETTER, NUMBER, SPACE], np.uint8)[categories()]
        # Of characters newer than Python's database the library's own pattern tells the class.
        split = Split(Regex(PATTERN), "removed", True)
        new = np.flatnonzero(unassigned())
        for before, kind in (("!", NUMBER), ("a", LETTER)):
            pieces = {x for x, _ in split.pre_tokenize_str(" ".join(before + chr(i) for i in new))}
            for i in new:
                if (before + chr(i) in pieces) == (kind == LETTER):
                    table[i] = kind
        for letters, kind in (("stmd", SHORT), ("rv", PENDING), ("l", ELL), ("e", EE), ("'", APOSTROPHE)):
            table[[ord(c) for c in letters]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The state before each character of (chunks, CHUNK) classes, from START at the first."""
    chunks, width = kinds.shape
    columns = np.ascontiguousarray(kinds.T)
    flat = NEXT.ravel()
    # The map of each chunk, from all states.
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (chunks, 8)).copy()
    for column in columns:
        maps = flat[maps.astype(np.int16) * 9 + column[:, None]]
    # Inclusive prefix scan: afterwards maps[k] goes through the chunks 0 to k.
    reach = 1
    while reach < chunks:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), 1)
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((width, chunks), np.uint8)
    for k, column in enumerate(columns):
        out[k] = state
        state = flat[state.astype(np.int16) * 9 + column]
    return out.T


def words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of code points begin and end."""
    kinds = classes()[points]
    padded = np.zeros(-(-(len(points) + 1) // CHUNK) * CHUNK, np.uint8)
    padded[: len(points)] = kinds
    emitted = EMIT[states_before(padded.reshape(-1, CHUNK)), padded.reshape(-1, CHUNK)].ravel()
    begins = (emitted & HERE) > 0
    begins[:-1] |= (emitted[1:] & BEFORE) > 0
    start = np.flatnonzero(begins[: len(points)])
    # A word ends where the next one or white space begins.
    edges = begins[: len(points)] | (kinds == SPACE)
    edge = np.append(np.flatnonzero(edges), len(points))
    return start, edge[np.searchsorted(edge, start, "right")]


class Transducer:
    """The second transducer. Symbols are bytes; a word's last byte counts 256 more."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, letters = told["model"], byte_letters()
        end = model["end_of_word_suffix"]
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != PATTERN or [x["type"] for x in told["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a word-end vocabulary with lower case and the split pattern above is needed")

        def symbols(token: str) -> tuple[int, ...]:
            body = token.removesuffix(end)
            out = tuple(letters[c] for c in body)
            return out if body == token else (*out[:-1], out[-1] + 256)

        special = {x["content"] for x in told["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.token = {symbols(t): i for t, i in model["vocab"].items() if t not in special}
        self.string = {i: s for s, i in self.token.items()}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[symbols(a), symbols(b)] = rank
        self.prefixes = {s[:k] for s in self.token for k in range(1, len(s) + 1)}
        self.longest = max(map(len, self.token))
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.clear()
        self.kept = Encodings(self.fresh)

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.told: list[tuple] = []
        self.edges: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.state((), (-1,), (0,))

    def state(self, *key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.told)
            self.told.append(key)
        return found

    def encoded(self, string: tuple[int, ...]) -> list[tuple[int, ...]]:
        parts = [(s,) for s in string]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, last: int, token: int) -> bool:
        """Whether a token may stand behind another (-1: at the beginning)."""
        found = self.pairs.get((last, token))
        if found is None:
            parts = [self.string[t] for t in (last, token) if t >= 0]
            found = self.pairs[last, token] = self.encoded(sum(parts, ())) == parts
        return found

    def compile(self, state: int, symbol: int) -> int:
        """Make the transition of a state by a symbol: next state and change of the number of tokens, packed."""
        string, last, count = self.told[state]  # bytes of the window; last token and count at each place of it
        string = (*string, symbol)
        for k in range(len(string)):
            token = self.token.get(string[k:])
            if token is not None and last[k] is not None and self.follows(last[k], token):
                break
        else:
            raise ValueError("a byte is not in the vocabulary")
        last, count = (*last, token), (*count, count[k] + 1)
        change = count[-1] - count[-2]
        if symbol >= 256:
            return self.edges.setdefault(state << 9 | symbol, change + 128)
        keep = next(k for k in range(len(string) + 1) if string[k:] in self.prefixes or k == len(string))
        base = count[-1]
        after = self.state(string[keep:], last[keep:], tuple(c - base for c in count[keep:]))
        return self.edges.setdefault(state << 9 | symbol, after << 8 | change + 128)

    def read(self, state: int, symbols: tuple[int, ...] | bytes) -> tuple[int, int]:
        """The state behind symbols that are read from a state, and by how much the number of tokens changes."""
        total, edges = 0, self.edges
        for s in symbols:
            edge = edges.get(state << 9 | s)
            if edge is None:
                edge = self.compile(state, s)
            state = edge >> 8
            total += (edge & 255) - 128
        return state, total

    def count(self, word: bytes) -> int:
        """The number of tokens of a word; long words by maps of their chunks, composed through a prefix scan."""
        if len(word) <= LONG_WORD:
            state, total = self.read(0, word[:-1])
            return total + self.read(state, (word[-1] + 256,))[1]
        symbols = (*word[:-1], word[-1] + 256)
        chunks = [symbols[i : i + CHUNK] for i in range(0, len(symbols), CHUNK)]
        # The states in which a chunk may be entered: as the chunk before leaves it if that began the word (mostly the
        # state itself, as what came earlier is soon forgotten), and what the maps before then give.
        entries = [{0}, *({self.read(0, c)[0]} for c in chunks[:-1])]
        maps = []
        for k, chunk in enumerate(chunks):
            maps.append({e: self.read(e, chunk) for e in entries[k]})
            if k + 1 < len(chunks):
                entries[k + 1] |= {after for after, _ in maps[k].values()}
        reach = 1
        while reach < len(maps):
            maps[reach:] = [{e: (late[x][0], n + late[x][1]) for e, (x, n) in early.items()} for early, late in zip(maps[:-reach], maps[reach:], strict=True)]
            reach *= 2
        return maps[-1][0][1]

    def fresh(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.edges) > KEPT:
            self.clear()
        return np.fromiter(map(self.count, found), np.uint32, len(found)), np.ones(len(found), np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        specials = np.zeros(len(texts), np.int64)
        clean = []
        for i, text in enumerate(texts):
            if "<|" in text:
                specials[i] = len(self.special.findall(text))
                text = self.special.sub(" ", text)
            if not text.isascii():
                if unassigned()[code_points([text])[0]].any():
                    text = self.normalizer.normalize_str(text)  # newer characters than Python's database has
                # Each character is lowered by itself, so a final sigma is like any other.
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            clean.append(text.lower() + "\n")
        points, begin = code_points(clean)
        start, stop = words(points)
        # Places in UTF-8.
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64), out=at[1:])
        found, _ = self.kept("".join(clean).encode(), at[start], at[stop])
        total = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
        return np.diff(total[np.searchsorted(start, begin)]) + specials


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def _counted(path: str, limit: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            raw = [t.encode() for t in texts]
            found = [machine.counts(texts[a:b]) for a, b in grouped(raw)]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return go


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens)."""
    ready(docs.sparkSession)
    docs = named(docs, doc_id=id_col, text=text_col)
    return docs.mapInArrow(_counted(tokenizer, limit), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
