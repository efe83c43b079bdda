"""Columns of numbers in few bytes, for shuffles: planes of bytes, compressed; and sorted numbers by their differences."""

from __future__ import annotations

import numpy as np
import zstandard

_IN, _OUT = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, the lowest of all first, then the next ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def put(*columns: np.ndarray) -> bytes:
    """Columns of any lengths and integer types."""
    head = np.array([len(columns), *[v for c in columns for v in (len(c), ord(c.dtype.char))]], np.int64).tobytes()
    return _IN.compress(head + b"".join(planes(c) for c in columns))


def get(blob: bytes) -> list[np.ndarray]:
    raw = _OUT.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for length, kind in head.reshape(n, 2).tolist():
        dtype = np.dtype(chr(kind))
        flat = np.frombuffer(raw, np.uint8, length * dtype.itemsize, at)
        out.append(np.ascontiguousarray(flat.reshape(dtype.itemsize, length).T).view(dtype).reshape(length))
        at += length * dtype.itemsize
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first from zero."""
    x = ascending.view(np.uint64)
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def sums(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)
