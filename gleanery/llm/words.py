"""Encodings of words kept within a task: each distinct piece of text is encoded once, and numpy joins the results."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

#: Pieces, and bytes of pieces, that a task keeps; beyond either it starts afresh.
KEPT, KEPT_BYTES = 1 << 20, 1 << 26


class Encodings:
    """Integers for each piece, made by `encode` for pieces not seen before: list of bytes -> (flat integers, counts).

    Pieces are told apart by their bytes, never by a hash of them alone.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The integers of all pieces, one after the other, and how many each piece has."""
        if len(self.known) > KEPT or self.bytes > KEPT_BYTES:
            self.clear()
        known, n = self.known, len(self.known)
        pieces = [text[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        at = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            at[unseen] = [known.setdefault(pieces[i], len(known)) for i in unseen.tolist()]
            first = np.unique(at[unseen], return_index=True)[1]
            fresh = [pieces[i] for i in unseen[first].tolist()]
            assert len(fresh) == len(known) - n
            self.bytes += sum(map(len, fresh))
            flat, counts = self.encode(fresh)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        begin, count = self.start[at], self.start[at + 1] - self.start[at]
        total = np.cumsum(count)
        within = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - count, count)
        return self.flat[np.repeat(begin, count) + within], count


def per_text(begin: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where each text's integers begin and end, of texts that begin at the given bytes (one entry more than texts)."""
    total = np.concatenate([[0], np.cumsum(count)])
    return total[np.searchsorted(start, begin)]
