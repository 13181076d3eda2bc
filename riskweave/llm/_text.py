"""Vectorised text kit shared by the operators of this subpackage.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text; everything else separates. In a regular
expression: ``[0-9a-z\\x{80}-\\x{10FFFF}]+`` over ``lower(text)``. Texts arrive
as Arrow batches; the kit works on their byte buffers with numpy, so no Python
object is made for a word. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once. A longer text is handled alone, never cut.
CHUNK_BYTES = 1_500_000

_U = np.uint64
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
_rng = np.random.Generator(np.random.PCG64(20240611))
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
_TABLE = WORD_BYTE.tobytes()
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_BASE = _U(0xD6E8FEB86659FD93)
_INV_BASE = _U(pow(int(_BASE), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, at least one row."""
    for batch in batches:
        n, at = batch.num_rows, buffer(batch.column(column))[1]
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _step(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


class Words:
    """Words of a batch of (already lower-cased) texts.

    hash: a 64-bit hash of each word; first: index of each text's first word,
    with one more entry at the end; begin, end: byte positions in ``data``.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.at = data, at = buffer(texts)
        flag = np.frombuffer(data.tobytes().translate(_TABLE), bool)
        before = np.empty_like(flag)
        if len(data):
            before[0] = False
            before[1:] = flag[:-1]
            before[at[:-1][at[:-1] < len(data)]] = False
        self.begin = np.flatnonzero(flag & ~before)
        after = np.empty_like(flag)
        if len(data):
            after[-1] = False
            after[:-1] = flag[1:]
            cut = at[1:-1]
            after[cut[cut > 0] - 1] = False
        self.end = np.flatnonzero(flag & ~after) + 1
        self.first = np.searchsorted(self.begin, at)
        self._flag = flag
        self._eight: np.ndarray | None = None
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.prefix_hash(None)
        return self._hash

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def prefix_hash(self, n: int | None) -> np.ndarray:
        """A hash of the first n bytes of each word (of all of it where n is None or more), eight bytes at a time."""
        if not len(self):
            return np.zeros(0, np.uint64)
        if self._eight is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        size = self.end - self.begin if n is None else np.minimum(self.end - self.begin, n)
        h = _step(np.zeros(len(self), np.uint64), self._eight[self.begin] & _MASK[np.minimum(size, 8)])
        done, more = 8, np.flatnonzero(size > 8)
        while len(more):
            h[more] = _step(h[more], self._eight[self.begin[more] + done] & _MASK[np.minimum(size[more] - done, 8)])
            done += 8
            more = more[size[more] > done]
        return mix(h + size.astype(np.uint64))

    def grams(self, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the text) of each run of n words. With ``short``, a text of fewer words has one gram, of all of them."""
        h, counts = self.hash, self.counts
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        number = np.maximum(counts - n + 1, 0)
        doc = np.repeat(np.arange(len(counts)), number)
        at = np.repeat(self.first[:-1], number) + np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        g = self.runs(at, n)
        if short:
            for d in np.flatnonzero((counts > 0) & (counts < n)):
                own = h[self.first[d] : self.first[d + 1]]
                g = np.append(g, mix((own * _GRAM[: len(own)]).sum(keepdims=True) + _U(len(own))))
                doc = np.append(doc, d)
        return g, doc

    def runs(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs of n words that begin at the given word indices; all must fit."""
        h = self.hash
        if n <= 8:
            g = np.zeros(len(at), np.uint64)
            for j in range(n):
                g += h[at + j] * _GRAM[j]
            return mix(g + _U(n))
        power, inverse = _powers(len(h))
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], dtype=np.uint64, out=total[1:])
        return mix((total[at + n] - total[at]) * inverse[at] + _U(n))


_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, _INV_BASE)):
            t = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            t[0] = 1
            _tables[k] = np.cumprod(t, dtype=np.uint64)
    return _tables
