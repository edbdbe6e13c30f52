"""Quality rules with a byte model of words.

The base rules count words, symbols, repeated lines and repeated windows of eight words of each text. The verdict of the
method is a perplexity a word, of a modified Kneser-Ney model of ORDER bytes whose contexts end at the white space before
the word. All documents are counted, by language and fold (half of the texts, told by their hash, so that exact copies
stay together), and each document is scored by the other fold's model; so a text never vouches for itself. The number of
n-grams has no bound but 256^ORDER and grows with the corpus.

1. Documents are dealt into chunks of about CHUNK bytes, as compressed batches. A task turns a chunk into its distinct
   n-grams and their counts: sorted arrays of their numbers (a perfect hash), for each language and part.
2. A part is the two bytes before the last. All that smoothing needs for orders 3 and up (contexts, shorter n-grams,
   continuations) lies in the same part, so parts are summed (chunks first in groups of GROUP) and smoothed on their own.
   Orders 1 and 2 (256^2 numbers) and the discounts are made for each language from what its parts tell.
3. Each chunk's n-grams meet the other fold's part; their probabilities return in the same order. Nothing of the model comes to
   the driver, and no task holds more than a part or a chunk.
4. Chunks meet their answers, and each text's probabilities are summed.

A document is rejected if its perplexity lies outside its language's band: BAND quartile distances of the logarithm
beyond the quartiles, over all documents of the language that pass the base rules, and more for short texts, whose
perplexity varies with the root of their length (SHORT characters: twice the band). Quartiles are those of the logarithm
in thousandths, by counting, so they do not depend on how the table is partitioned.

The language is the column `lang`; rows without one form a language of their own. A null text has no words and fails
the base rules. Every row gives one row; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, grouped, materialize, mix, named, ready, words_of

LEAST_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
BAND, SHORT = 3.0, 400
#: Bytes of an n-gram (7 at most), and the lowest order that parts hold.
ORDER, LOWEST = 7, 3
#: Bytes of text of a chunk (of CHUNKS chunks at least) and of a batch, and chunks whose counts are summed at a time.
CHUNK, CHUNKS, BATCH, GROUP = 48 << 20, 8, 1 << 20, 256
#: Characters that count as symbols, by the rule's definition.
MARKS = "#*$%&|<>"

_WHITE = np.zeros(256, bool)
_WHITE[[0, 9, 10, 11, 12, 13, 32]] = True


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each byte of each text, as numbers, and where each text's begin.

    An n-gram reaches back to the white space before the word (that of a space: before the word it ends); the bytes
    before that are 0.
    """
    pad = bytes(ORDER - 1)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    code = np.zeros(len(data), np.uint64)
    for k in range(ORDER):
        code[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    place = np.arange(len(data))
    white = _WHITE[data]
    last = np.maximum.accumulate(np.where(white, place, -1))
    before = np.where(white, np.concatenate([[-1], last[:-1]]), last)
    code &= _MASK[np.minimum(ORDER, place - before + 1)]
    own = np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), size) + np.arange(int(begin[-1]))
    return code[own], begin


_MASK = np.array([(1 << 8 * k) - 1 for k in range(ORDER + 1)], np.uint64)


# --- counts and model ----------------------------------------------------------------------------------------------


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(first) else count


NOTHING = np.zeros(0, np.uint64), np.zeros(0, np.int64)
#: Of each fold: the bytes of n-grams before and behind the two that the part tells, and counts.
ARRAYS = ", ".join(f"{x}{f} binary" for f in (0, 1) for x in ("upper", "lower", "counts"))
_ARRAYS = ARRAYS.replace(" binary", "").replace(",", "")


def _packed(code: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, bytes]:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(count) or int(count.max()) <= np.iinfo(k).max)
    return (code >> np.uint64(24)).astype("<u4").tobytes(), code.astype("<u1").tobytes(), count.astype(kind).tobytes()


def _unpacked(row: dict, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams and counts of a row of a part."""
    upper, lower, counts = (row[f"{x}{fold}"] for x in ("upper", "lower", "counts"))
    code = np.frombuffer(upper, "<u4").astype(np.uint64) << np.uint64(24) | np.uint64(row["part"] << 8) | np.frombuffer(lower, "<u1")
    return code, np.frombuffer(counts, f"<u{len(counts) // max(1, len(code)) or 1}").astype(np.int64)


def part_of(code: np.ndarray) -> np.ndarray:
    return ((code >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)


def fold_of(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) & 1


def _by_fold(texts: list[bytes], langs: list[str]) -> Iterator[tuple[tuple[str, int], np.ndarray, np.ndarray, np.ndarray]]:
    """For each language and fold among texts: their places, n-grams and where each text's begin."""
    kinds = [(lang, fold_of(text)) for lang, text in zip(langs, texts, strict=True)]
    for kind in dict.fromkeys(kinds):
        own = np.array([i for i, k in enumerate(kinds) if k == kind])
        yield kind, own, *grams_of([texts[i] for i in own])


def _table(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names.split(), kinds, strict=True))})


_KINDS = {"lang": pa.string(), "part": pa.int64(), "salt": pa.int64(), "chunk": pa.int64()}


def _arrays(keys: str, rows: list[tuple]) -> pa.Table:
    return _table(rows, f"{keys} {_ARRAYS}", [*(_KINDS[k] for k in keys.split()), *[pa.binary()] * 6])


def _batches(chunks: int):
    """Documents (doc_id, text, lang) as compressed batches, each with the number of its chunk."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for a, b in grouped([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], BATCH):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
                    stream.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([place % chunks], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])
                place += 1

    return go


def _opened(docs: bytes) -> tuple[pa.Table, list[bytes], list[str]]:
    table = pa.ipc.open_stream(docs).read_all()
    return table, [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()], table["lang"].to_pylist()


class Grams:
    """The distinct n-grams of a chunk and their counts, by language and fold, in the order of part and number."""

    def __init__(self):
        self.held: dict[tuple[str, int], list] = {}

    def add(self, docs: bytes) -> None:
        _, texts, langs = _opened(docs)
        for a, b in grouped(texts):
            for key, _, codes, _ in _by_fold(texts[a:b], langs[a:b]):
                lists = self.held.setdefault(key, [])
                lists.append(np.unique(codes, return_counts=True))
                if len(lists) > 1 and sum(len(x) for x, _ in lists[1:]) > 2 * len(lists[0][0]) + (1 << 18):
                    lists[:] = [_merged(*zip(*lists, strict=True))]

    def parts(self, lang: str, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, counts = _merged(*zip(*self.held.get((lang, fold), [NOTHING]), strict=True))
        order = np.argsort(part_of(codes), kind="stable")
        return codes[order], counts[order], part_of(codes[order])


def _counted(groups: int):
    """The n-grams of each chunk and their counts, one row for each language and part."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Grams] = {}
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(chunk, Grams()).add(docs)
        for chunk in list(held):
            grams = held.pop(chunk)
            for lang in dict.fromkeys(lang for lang, _ in grams.held):
                parts: dict[int, list] = {}
                for fold in (0, 1):
                    codes, counts, part = grams.parts(lang, fold)
                    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else [], len(part)).astype(np.int64)
                    for x, y in zip(edge[:-1], edge[1:], strict=True):
                        parts.setdefault(int(part[x]), [_packed(*NOTHING), _packed(*NOTHING)])[fold] = _packed(codes[x:y], counts[x:y])
                yield from _arrays("lang part salt chunk", [(lang, part, chunk % groups, chunk, *x, *y) for part, (x, y) in parts.items()]).combine_chunks().to_batches()

    return go


def _sum(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the rows of one part, the codes and counts of each fold."""
    rows = table.to_pylist()
    return [_merged(*zip(*(_unpacked(r, f) for r in rows), strict=True)) for f in (0, 1)]


def _summed(table: pa.Table) -> pa.Table:
    row = [x for fold in _sum(table) for x in _packed(*fold)]
    return _arrays("lang part", [(table["lang"][0].as_py(), table["part"][0].as_py(), *row)])


def levels(code: np.ndarray, count: np.ndarray, lowest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """N-grams and their counts, from ORDER down; below, the counts are how many bytes stand before an n-gram."""
    out = [(code, count)]
    for k in range(ORDER - 1, lowest - 1, -1):
        out.append(np.unique(out[-1][0] & _MASK[k], return_counts=True))
    return out


def histogram(count: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(count, 5), minlength=6)[1:5]


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts of modified Kneser-Ney smoothing for counts of 1, 2 and more, at places 1 to 3."""
    n = np.maximum(1, n)
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(float(k), max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))])


def _told(table: pa.Table) -> pa.Table:
    """What a part tells its language: histograms of the counts of orders from ORDER down to LOWEST, and its pairs of last bytes."""
    row = []
    for fold in _sum(table):
        found = levels(*fold, LOWEST)
        row += [np.concatenate([histogram(c) for _, c in found]).astype("<i8").tobytes(), np.unique(found[-1][0] & _MASK[2]).astype("<u2").tobytes()]
    return _table([(table["lang"][0].as_py(), *row)], "lang hist0 pairs0 hist1 pairs1", [pa.string(), *[pa.binary()] * 4])


def _low(table: pa.Table) -> pa.Table:
    """For one language: discounts of all orders from ORDER down, and the probabilities of the last byte after each byte."""
    rows, folds = table.to_pylist(), []
    for f in (0, 1):
        hist = sum(np.frombuffer(r[f"hist{f}"], "<i8") for r in rows).reshape(-1, 4)
        two = sum(np.bincount(np.frombuffer(r[f"pairs{f}"], "<u2"), minlength=1 << 16) for r in rows).reshape(256, 256)
        one = (two > 0).sum(0)
        p = np.full(256, 1 / 256)
        for count in (one[None, :], two):
            d = discounts(histogram(count[count > 0]))[np.minimum(count, 3)]
            total = count.sum(1, keepdims=True)
            p = np.where(total > 0, (count - d + d.sum(1, keepdims=True) * p) / np.maximum(1, total), p)
        folds.append((np.concatenate([discounts(h) for h in hist]), p))
    out = [(rows[0]["lang"], b, b"".join(d.tobytes() + p[b].tobytes() for d, p in folds)) for b in range(256)]
    return _table(out, "lang last low", [pa.string(), pa.int64(), pa.binary()])


def smoothed(found: list[tuple[np.ndarray, np.ndarray]], discount: np.ndarray) -> list[tuple]:
    """For each order from LOWEST up: n-grams, what each keeps of its probability, contexts and what each leaves to shorter n-grams."""
    out = []
    for (code, count), d in zip(reversed(found), reversed(discount), strict=True):
        off = d[np.minimum(3, count)]
        context = code >> np.uint64(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(code) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, first) if len(first) else count
        left = (np.add.reduceat(off, first) if len(first) else off) / np.maximum(1, total)
        out.append((code, (count - off) / np.repeat(total, np.diff(np.append(first, len(code)))), context[first], left))
    return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, without: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), without)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], without)


def log_probabilities(model: list[tuple], low: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The logarithms of the interpolated probabilities of sorted n-grams of one part."""
    need = [wanted]
    for k in range(ORDER - 1, LOWEST - 1, -1):
        need.append(np.unique(need[-1] & _MASK[k]))
    need.reverse()
    p = low[(need[0] & _MASK[1]).astype(np.int64)]
    for k, (code, own, context, left) in enumerate(model):
        if k:
            p = p[np.searchsorted(need[k - 1], need[k] & _MASK[LOWEST + k - 1])]
        p = _found(code, own, need[k], 0.0) + _found(context, left, need[k] >> np.uint64(8), 1.0) * p
    return np.log(p)


def _answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    """The probabilities that the other fold's model gives the n-grams of each chunk, for one part."""
    rows, told = asked.to_pylist(), model.to_pylist()[0]
    low = np.frombuffer(told["low"], "<f8").reshape(2, -1)
    out = [[r["chunk"], r["lang"], r["part"]] for r in rows]
    for f in (0, 1):
        g = 1 - f
        other = smoothed(levels(*_unpacked(told, g), LOWEST), low[g, :-256].reshape(-1, 4))
        codes = [_unpacked(r, f)[0] for r in rows]
        wanted = np.unique(np.concatenate([NOTHING[0], *codes]))
        answer = log_probabilities(other, low[g, -256:], wanted).astype("<f4") if len(wanted) else np.zeros(0, "<f4")
        for row, c in zip(out, codes, strict=True):
            row.append(answer[np.searchsorted(wanted, c)].tobytes())
    return _table(out, "chunk lang part p0 p1", [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()])


# --- base rules ----------------------------------------------------------------------------------------------------


def repeated_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of WINDOW words that a text holds twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        rolled = hashes[:n].copy()
        for k in range(1, WINDOW):
            rolled = mix(rolled * np.uint64(31) + hashes[k : k + n])
    order = np.argsort(rolled)
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[:n] += twice
    cover[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(cover) > 0).sum())


SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, perplexity double"
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True


def base_counts(raw: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    hashes, start, stop, begin = words_of(raw, lower=False)
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    heads = np.zeros(len(data) + 1, np.int64)  # bytes that begin a code point
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_MARK[data], out=marks[1:])
    chars = np.concatenate([[0], np.cumsum(heads[stop] - heads[start])])
    edge = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return [
        (int(begin[i + 1] - begin[i]), int(chars[begin[i + 1]] - chars[begin[i]]), int(marks[edge[i + 1] - 1] - marks[edge[i]]), repeated_lines(raw[i]), repeated_words(hashes[begin[i] : begin[i + 1]]))
        for i in range(len(raw))
    ]


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Base counts and perplexity of the documents of one chunk."""
    grams = Grams()
    blobs = docs["docs"].to_pylist()
    for blob in blobs:
        grams.add(blob)
    rows = sorted(answers.to_pylist(), key=lambda r: r["part"])
    told: dict[tuple, tuple] = {}
    for lang, fold in grams.held:
        codes = grams.parts(lang, fold)[0]
        p = np.frombuffer(b"".join(r[f"p{fold}"] for r in rows if r["lang"] == lang), "<f4")
        order = np.argsort(codes)
        told[lang, fold] = codes[order], p[order].astype(np.float64)
    out = []
    for blob in blobs:
        table, raw, langs = _opened(blob)
        score, counts = np.zeros(len(raw)), []
        for a, b in grouped(raw):
            for key, own, codes, begin in _by_fold(raw[a:b], langs[a:b]):
                if len(codes):
                    known, p = told[key]
                    # Each text is summed by itself, so what stands around it does not matter.
                    total = np.add.reduceat(np.append(p[np.searchsorted(known, codes)], 0.0), begin[:-1])
                    score[a + own] = np.where(np.diff(begin) > 0, total, 0.0)
            counts += base_counts(raw[a:b])
        found = [(*c, float(np.exp(min(700.0, -x / c[0]))) if c[0] else None) for c, x in zip(counts, score.tolist(), strict=True)]
        names = "n_words word_chars n_symbols n_dup_lines n_repeat_words perplexity"
        scores = _table(found, names, [*[pa.int64()] * 5, pa.float64()])
        out.append(pa.table([table["doc_id"], table["lang"], *scores.columns], names=["doc_id", "lang", *names.split()]))
    return pa.concat_tables(out)


def perplexities(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and the perplexity a word of rows (doc_id, text, lang)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(CHUNKS, 1 + int(size) // CHUNK)
    groups = 1 + chunks // GROUP
    dealt = docs.select("doc_id", "text", "lang").mapInArrow(_batches(chunks), "chunk long, docs binary").repartition("chunk")
    asked = dealt.mapInArrow(_counted(groups), f"lang string, part long, salt long, chunk long, {ARRAYS}")
    some = asked.groupBy("lang", "part", "salt").applyInArrow(_summed, f"lang string, part long, {ARRAYS}")
    model = some.groupBy("lang", "part").applyInArrow(_summed, f"lang string, part long, {ARRAYS}")
    told = some.groupBy("lang", "part").applyInArrow(_told, "lang string, hist0 binary, pairs0 binary, hist1 binary, pairs1 binary")
    low = told.groupBy("lang").applyInArrow(_low, "lang string, last long, low binary").withColumnRenamed("lang", "of")
    model = model.join(low, (F.col("lang") == F.col("of")) & (F.col("part") % 256 == F.col("last"))).drop("of", "last")
    model = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    keys = ["lang", "part", "salt"]
    answers = asked.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInArrow(_answered, "chunk long, lang string, part long, p0 binary, p1 binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored, f"doc_id {kind}, lang string, {SCORES}")


def quartiles(scored: DataFrame) -> DataFrame:
    """(language, low, high): the quartiles of the logarithm of perplexity, in thousandths, by counting."""
    bins = scored.where("perplexity is not null").groupBy("lang", F.round(1000 * F.log("perplexity")).alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    placed = bins.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    pick = lambda share: (F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) / 1000)
    return placed.groupBy("lang").agg(pick(0.25).alias("low"), pick(0.75).alias("high")).withColumnRenamed("lang", "language")


def assess(docs: DataFrame, band: float = BAND, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, perplexity and the text's band (lower, upper)."""
    ready(docs.sparkSession)
    docs = named(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    scored = materialize(perplexities(docs))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    bands = quartiles(scored.where("not base_failed"))
    small = bands.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = scored.join(F.broadcast(bands) if small else bands, F.col("lang") == F.col("language"), "left")
    margin = band * (F.col("high") - F.col("low")) * (1 + F.sqrt(SHORT / F.greatest(F.lit(1), "word_chars")))
    joined = joined.withColumn("lower", F.exp(F.col("low") - margin)).withColumn("upper", F.exp(F.col("high") + margin))
    within = F.col("perplexity").between(F.col("lower"), F.col("upper"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"), "perplexity", "lower", "upper",
    )
