"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits, plus signs and identifier cues. At each
anchor a deterministic local parser expands to both sides and validates what it finds. The base kinds are email, ip,
card and phone; within a kind, spans are leftmost and do not overlap, and what fails its validation is dropped. The
method adds url (scheme and host), account (IBANs that pass mod 97, and numbers after an account cue) and address
(number and street word, in either order, after a capital; at most STREET_WORDS words of any length between them).
Parsers never look at a place twice as often as there are kinds, so the time follows the length of the text.

A null text counts as empty and has no spans. Texts are read whole; positions are code points. Every row gives one
row, so repeated rows are repeated; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, ready, small

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"://[^\s<>\"']*[^\s<>\"'.,;:!?)]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\s*(?:no|nr|number|nummer|numéro|número)\b)?[\s.:#=-]{0,4}(?=[A-Z0-9-]{0,31}[0-9]{4})([A-Z]{0,4}[0-9][A-Z0-9-]{4,29}[A-Z0-9])(?![A-Za-z0-9])")
#: Words that may stand between the number of a house and the street word.
STREET_WORDS = 3
NAME = re.compile(r"[A-ZÀ-Þ][\w'-]*")
NUMBER_BEFORE = re.compile(r"(?<![\w.])[0-9]{1,5}[A-Za-z]?,?$")
STREET_BEFORE = re.compile(r",? (?:[A-ZÀ-Þa-zà-ÿ'-]+ ){0,3}[A-ZÀ-Þ][\w'-]* ?,? ?[0-9]{1,5}\b|,? ?[0-9]{1,5}[a-z]?\b")

#: Words that stand before an account or personal number.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta", "Account", "Acct", "IBAN", "Passport", "SSN", "Konto", "Compte", "Cuenta")
#: Words that close an address ("12 Oak Street") and words that open one ("Rue de Rivoli 12").
STREETS_LAST = (" Street", " Avenue", " Road", " Lane", " Boulevard", " Drive")
STREETS_FIRST = ("Calle ", "Rue ", "rue ", "Avenida ")
STREETS_JOINED = ("straße", "strasse")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def automaton():
    """All anchors and the parsers that they wake."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for words, kind in (("@", "at"), ("+", "plus"), ("0123456789", "digit")):
        for word in words:
            found.add_word(word, (kind, 1))
    for words, kind in ((("://",), "scheme"), (ACCOUNT_CUES, "cue"), (STREETS_LAST, "last"), (STREETS_FIRST, "first"), (STREETS_JOINED, "joined")):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def number_before(text: str, at: int) -> int | None:
    """Where the number begins that stands, with one to STREET_WORDS names behind it, before a place; the leftmost."""
    found, end = None, at
    for _ in range(STREET_WORDS):
        start = text.rfind(" ", 0, end) + 1
        if not start or not NAME.fullmatch(text, start, end):
            break
        end = start - 1
        if m := NUMBER_BEFORE.search(text[max(0, end - 8) : end]):
            found = max(0, end - 8) + m.start()
    return found


_AUTOMATON: list = []


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind in one text."""
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    last = dict.fromkeys(KINDS, 0)
    run = -2  # the last digit seen: only the first of a run is an anchor
    letters_from = letters_to = 0  # letters before the last joined street word: looked at once
    for end, (kind, size) in _AUTOMATON[0].iter(text):
        at = end - size + 1
        if kind == "digit":
            fresh, run = at != run + 1, at
            if not fresh:
                continue
            if at >= last["ip"] and (m := IP.match(text, at)):
                last["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out["ip"].append(m.span())
            if at >= last["card"] and (m := CARD.match(text, at)):
                last["card"] = m.end()
                digits = only_digits(m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if at >= 2 and text[at - 1].isupper() and (at < 3 or not text[at - 3].isalnum()) and at - 2 >= last["account"] and (m := IBAN.match(text, at - 2)) and iban(m[0]):
                last["account"] = m.end()
                out["account"].append(m.span())
        elif kind == "at":
            start = at
            while start > last["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                last["email"] = m.end()
                out["email"].append((start, m.end()))
        elif kind == "plus":
            if at >= last["phone"] and (m := PHONE.match(text, at)):
                last["phone"] = m.end()
                if 9 <= len(only_digits(m[0])) <= 15:
                    out["phone"].append(m.span())
        elif kind == "scheme":
            start = at
            while start > last["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := URL_REST.match(text, at)):
                last["url"] = m.end()
                out["url"].append((start, m.end()))
        elif kind == "cue":
            if (at == 0 or not text[at - 1].isalnum()) and (m := ACCOUNT.match(text, at + size)) and m.start(1) >= last["account"]:
                last["account"] = m.end(1)
                out["account"].append(m.span(1))
        elif kind == "last":
            if (at + size == len(text) or not text[at + size].isalnum()) and (start := number_before(text, at)) is not None and start >= last["address"]:
                last["address"] = at + size
                out["address"].append((start, at + size))
        else:
            start = at
            if kind == "joined":  # the street's name begins with the letters before
                while start > letters_to and text[start - 1].isalpha():
                    start -= 1
                if start == letters_to and at > 0:
                    start = letters_from
                letters_from, letters_to = start, at
            whole = kind == "first" or text[start].isupper()
            if whole and (start == 0 or not text[start - 1].isalnum()) and (m := STREET_BEFORE.match(text, at + size - (kind == "first"))) and start >= last["address"]:
                last["address"] = m.end()
                out["address"].append((start, m.end()))
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in small(batches):
        ids, texts = batch.column(0), batch.column(1)
        sizes, kinds, starts, ends = [0], [], [], []
        for text in texts:
            for kind, spans in spans_of(text.as_py() or "").items():
                for start, end in spans:
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
            sizes.append(len(kinds))
        values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind_type))
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], names=["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans: an array of (kind, start, end), by kind as in KINDS, then start."""
    ready(docs.sparkSession)
    docs = named(docs, doc_id=id_col, text=text_col)
    return docs.mapInArrow(_found, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def _redacted(columns: list[str], text_col: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text_col)
        for batch in small(batches):
            out = []
            for value in batch.column(at):
                text = value.as_py()
                if text is not None:
                    spans = sorted((start, -end, kind) for kind, x in spans_of(text).items() for start, end in x)
                    parts, done = [], 0
                    for start, end, kind in spans:
                        if start >= done:
                            parts += [text[done:start], f"<{kind.upper()}>"]
                        done = max(done, -end)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return go


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with each span replaced by its kind, such as <EMAIL>; null texts stay null.

    Of overlapping spans the leftmost, then longest, names the replacement, and all of them are covered.
    """
    ready(docs.sparkSession)
    return docs.mapInArrow(_redacted(docs.columns, text_col), docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, from the spans of find_pii()."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
