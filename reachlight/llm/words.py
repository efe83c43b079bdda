"""Hashes of all words of many texts at once, in numpy.

A word is a longest run of ASCII letters and digits and of any non-ASCII characters; the text is lower-cased. The
hash is a polynomial modulo 2**64 taken from prefix sums, so its cost doesn't depend on the words' lengths.
"""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
WORD_BYTE[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        have = np.cumprod(grown, dtype=np.uint64)
        if n < 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words of a list of texts (None counts as empty).

    raw: all bytes; starts, ends: each word's place in raw; hashes: one for each word; first: where each text's words
    begin, with the total at the end.
    """

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        self.raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[1:] = WORD_BYTE[self.raw]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers(P, len(self.raw)), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * powers(P_INVERSE, len(self.raw) + 1)[self.starts]
        self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64))
        bounds = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
        self.first = np.searchsorted(self.starts, bounds)
        self.count = np.diff(self.first)

    def document(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that stay within a text, and the text of each. n = 1 gives the words."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n == 1:
        return hashes, doc
    size = max(0, len(hashes) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(31) + hashes[k : k + size])
    ok = doc[:size] == doc[n - 1 :] if size else np.zeros(0, bool)
    return h[ok], doc[:size][ok]
