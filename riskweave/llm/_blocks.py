"""Column blocks: rows that carry arrays of postings as binary.

A hash order over grams is cut into fragments of equal width. A mapper writes,
for each of its chunks and each fragment, one row of arrays; so a shuffle moves a
few bytes a posting and neither side handles postings as rows. A gram is known
by 64 bits of its hash, however many fragments there are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64


def fragments(size: int, each: int) -> int:
    """The least number of fragments of at most ``each`` on average."""
    return max(1, -(-size // each))


def fragment_of(h: np.ndarray, number: int) -> np.ndarray:
    f = ((h >> _U(32)) * _U(number)) >> _U(32)
    return f.astype(np.uint16 if number <= 1 << 16 else np.uint32)


def _murmur3(x: int) -> int:
    """The engine's hash of an int, as an unsigned number."""
    m = 0xFFFFFFFF
    rot = lambda v, r: (v << r | v >> (32 - r)) & m
    k = rot(x * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = (rot(42 ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


@lru_cache(maxsize=16)
def labels(number: int) -> np.ndarray:
    """An int for each fragment, so that a hash partitioning into ``number`` partitions has one fragment in each."""
    out, left, x = np.full(number, -1, np.int32), number, 0
    while left:
        h = _murmur3(x)
        p = (h - (1 << 32) if h >> 31 else h) % number
        if out[p] < 0:
            out[p] = x
            left -= 1
        x += 1
    return out


def joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def spans(counts: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs begins, with the end of the last."""
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    return at


def take_runs(at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs ``which``, run after run."""
    size = at[which + 1] - at[which]
    out = spans(size)
    return np.arange(out[-1]) + np.repeat(at[which] - out[:-1], size)


def sort_by(key: np.ndarray) -> np.ndarray:
    """Stable order of small integers."""
    return np.argsort(key, kind="stable")
