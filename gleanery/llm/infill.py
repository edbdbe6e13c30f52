"""Fill-in-the-middle by a matcher that goes over a text twice and stores nothing.

A text is cut into units: white space with the word behind it, or white space at the end. The first pass counts the
units; the second advances a lazy match iterator to both ranks and stops there, so besides the text and what is written
no memory is used, however many units there are. Ranks, form and order come from a hash of seed and id, so a row has the
same result wherever and whenever it is made.

The form is `plain` (the text as it is), `psm` (prefix, suffix, middle) or `spm` (suffix, prefix, middle); MARKS stand
before the parts. A text that holds a mark stays plain, so splitting an output at its marks gives its parts back.

A null text counts as empty and is plain; a null id hashes as an empty one. Texts are read whole; positions are code
points. Every row gives one row, so repeated rows are repeated; other columns are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, ready, small

SEED, RATE, SUFFIX_FIRST = 42, 50, 80
#: Before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: White space is taken without a way back, so a long run of it is read once.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")

RESULT = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: str) -> tuple[int, ...]:
    """Four numbers of 32 bits that follow from seed and id."""
    found = sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(found[i : i + 8], 16) for i in (0, 8, 16, 24))


def places(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first and the second unit counts end; nothing is matched beyond the second."""
    units = UNIT.finditer(text)
    a = 0
    for unit in islice(units, first - 1, first) if first else ():
        a = unit.end()
    b = a
    for unit in islice(units, second - first - 1, second - first) if second > first else ():
        b = unit.end()
    return a, b


def rearranged(text: str, numbers: tuple[int, ...], rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the output of one text."""
    n = sum(1 for _ in UNIT.finditer(text))
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places(text, first, second)
    p, s, m = MARKS
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def _transformed(seed: int, rate: int, suffix_first: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, keys = batch.column(0), batch.column(1).to_pylist()
            rows = [rearranged(t or "", draws(seed, k or ""), rate, suffix_first) for k, t in zip(keys, batch.column(2).to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip((n, form, prefix, middle, output), kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return go


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output; `rate` of 100 texts are rearranged, `suffix_first` of 100 of these as spm."""
    ready(docs.sparkSession)
    rows = named(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    return rows.mapInArrow(_transformed(seed, rate, suffix_first), RESULT.replace("doc_id string", f"doc_id {docs.schema[id_col].dataType.simpleString()}"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form."""
    parts = F.split(output, "|".join(MARKS))
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def digests(rearranged_docs: DataFrame) -> DataFrame:
    """The rows of transform() with SHA-256 of output and restored text in place of the output."""
    sha = lambda c: F.sha2(c, 256)
    return rearranged_docs.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
