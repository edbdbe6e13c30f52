"""Classes of code points as numpy tables, made once in a process from the Unicode database."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np


@cache
def categories() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 0 other."""
    kinds = {"L": 1, "N": 2, "Z": 3}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)
    out[[9, 10, 11, 12, 13, 0x85]] = 3
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and where each text's begin (one entry more than texts)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def unassigned() -> np.ndarray:
    """Code points of the first four planes that Python's Unicode database does not know (a library's may)."""
    out = np.zeros(0x110000, bool)
    out[:0x40000] = [unicodedata.category(chr(i)) == "Cn" for i in range(0x40000)]
    return out
