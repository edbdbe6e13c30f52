"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams (of 1 to 3 symbols) that both have, divided
by the root of the product of their numbers, over the n-grams that the landmarks have. Symbols are folded letters; all
else is a gap. Nyström features from a few landmark texts of each language and one-versus-rest kernel ridge regression
give one weight vector per language; whole texts are scored by matrix products, one for a group of texts.

Learning takes a bounded sample: of each language the PER_LANGUAGE texts whose ids have the least hashes, and of these
LANDMARKS as landmarks. Only their n-gram sets (at most 64^3 numbers each) come to the driver.

A null text, or one without a letter, is `und` with score 0, and so is everything if no labelled row is there to learn
from. Rows with a null id are scored as all others but never learnt from. Ties go to the first language by name.
Repeated rows are repeated; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, named, ready, small
from .letters import categories, code_points

UNKNOWN = "und"
#: Texts to learn from and landmarks, of each language.
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 48, 1e-3
#: Symbols (a power of two): gap, a to z, and buckets of other letters.
SYMBOLS = 64
SPACE_OF_GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
#: Symbols that are looked at in one step; longer texts take several.
STEP = 1 << 20

_FOLDED: list[np.ndarray] = []


def folded() -> np.ndarray:
    """The symbol of each code point: small and capital letters have the same."""
    if not _FOLDED:
        table = np.zeros(0x110000, np.int32)
        letters = np.flatnonzero(categories() == 1)
        small = np.array([ord(c) if len(c := chr(x).lower()) == 1 else x for x in letters], np.int64)
        ascii_ = small < 128
        table[letters[ascii_]] = small[ascii_] - 96
        table[letters[~ascii_]] = 27 + small[~ascii_] % (SYMBOLS - 27)
        _FOLDED.append(table)
    return _FOLDED[0]


def gram_steps(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of all n-grams of one text, step by step; gaps on both sides belong to it."""
    s = np.concatenate([[0], symbols, [0]])
    for at in range(0, len(s), STEP):
        part = s[at : at + STEP + 2]
        yield part
        two = part[:-1] * SYMBOLS + part[1:]
        yield SYMBOLS + two
        yield SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + part[2:]


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points, begin = code_points(texts)
    return folded()[points], begin


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        out = []
        for text in batch.column(1).to_pylist():
            flags = np.zeros(SPACE_OF_GRAMS, bool)
            for grams in gram_steps(_symbols([text])[0]):
                flags[grams] = True
            out.append(np.flatnonzero(flags).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["lang", "grams"])


def learn(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> dict:
    """Weights for the languages of rows (doc_id, text, lang) that are usable and labelled."""
    labelled = docs.where(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    sample = labelled.join(F.broadcast(chosen.select("doc_id", "lang", "place")), ["doc_id", "lang"]).select("lang", "text")
    rows = sorted((r["lang"], tuple(r["grams"])) for r in sample.mapInArrow(_gram_sets, "lang string, grams array<int>").toLocalIterator())
    if not rows:
        return {}
    languages = sorted({lang for lang, _ in rows})
    seen: dict[str, int] = {}
    is_landmark = []
    for lang, _ in rows:
        seen[lang] = seen.get(lang, 0) + 1
        is_landmark.append(seen[lang] <= landmarks)
    columns = np.unique(np.concatenate([g for (_, g), z in zip(rows, is_landmark, strict=True) if z]).astype(np.int64))
    where = np.full(SPACE_OF_GRAMS, len(columns), np.int32)
    where[columns] = np.arange(len(columns))
    x = np.zeros((len(rows), len(columns) + 1), np.float32)
    for i, (_, grams) in enumerate(rows):
        x[i, where[list(grams)]] = 1
    x = x[:, :-1]
    x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    z = x[np.array(is_landmark)]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # the kernel's inverse root: Nyström features are k(x, z) @ root
    features = (x @ z.T).astype(np.float64) @ root
    y = np.where(np.array([[lang == other for other in languages] for lang, _ in rows]), 1.0, -1.0)
    weight = np.sqrt(1.0 / (y > 0).sum(0))  # languages count alike, however many rows each has
    share = (y > 0) @ weight**2
    gram = features.T @ (features * share[:, None])
    solved = np.linalg.solve(gram + RIDGE * np.eye(gram.shape[0]), features.T @ (y * share[:, None]))
    return {"languages": languages, "where": where, "landmarks": z.T.copy(), "weights": (root @ solved).astype(np.float32)}


def score_texts(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the best language (-1: unknown) and its score, for each text."""
    symbols, begin = _symbols(texts)
    where, columns = model["where"], model["landmarks"].shape[0]
    x = np.zeros((len(texts), columns + 1), np.float32)
    letters = np.zeros(len(texts), bool)
    for i in range(len(texts)):
        own = symbols[begin[i] : begin[i + 1]]
        letters[i] = own.any()
        for grams in gram_steps(own):
            x[i, where[grams]] = 1
    x = x[:, :-1]
    x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    scores = (x @ model["landmarks"]) @ model["weights"]
    best = scores.argmax(1)
    # Of a regression on -1 and 1, half of what lies above -1.
    score = np.clip((scores[np.arange(len(texts)), best] + 1) / 2, 0, 1)
    return np.where(letters, best, -1), np.where(letters, score, 0.0)


def predictions(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, in groups by size and of at most 512 texts, so that matrices stay small."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model:
        for a, b in grouped([t.encode() for t in texts]):
            for c in range(a, b, 512):
                best, score = score_texts(model, texts[c : min(b, c + 512)])
                names[c : c + len(best)] = [model["languages"][k] if k >= 0 else UNKNOWN for k in best]
                scores[c : c + len(best)] = score
    return names, scores


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _predicted(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names, scores = predictions(shared.value, _texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return go


def _known(shared, at: int, least: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names, scores = predictions(shared.value, _texts(batch.column(at)))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return go


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, from the text alone."""
    ready(docs.sparkSession)
    docs = named(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predicted(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that learning never sees: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learns from the rows that are not held out and predicts all."""
    ready(docs.sparkSession)
    docs = named(docs, doc_id="doc_id", text="text", lang="lang")
    found = predict(docs, learn(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def filter_known(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows whose text has a known language with at least the given score, with all their columns.

    Each row is judged by its own text: rows that share a doc_id, or have none, do not matter to each other.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(named(docs, doc_id="doc_id", text="text", lang="lang"), ~held_out()))
    return docs.mapInArrow(_known(shared, docs.columns.index("text"), least), docs.schema)
