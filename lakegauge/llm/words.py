"""Words of whole Arrow text columns, found and hashed with numpy.

A word is a run of bytes other than space and 0x09-0x0D. All texts of a batch are handled at once; a word never
crosses from one text into the next. Hashes depend on bytes only, so they agree between executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BYTE = np.random.default_rng(20240607).integers(1, 2**64, size=(2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the n + 1 offsets; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


@dataclass
class Words:
    """Words of a batch in order. ``first`` has, by text, the index of its first word, and the total at the end."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray  # (hashes, words)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def sequences(self, n: int, which: int = 0) -> np.ndarray:
        """Hash of the n words from each word on; only those are meant for which ``inside(n)``."""
        h = self.hash[which]
        size = max(0, len(h) - n + 1)
        out = np.zeros(size, np.uint64)
        for j, p in enumerate(powers(_BASE[1 - which] | 1, n)):
            out += h[j : j + size] * p
        return mix64(out)

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each word on belong to one text."""
        size = max(0, len(self.doc) - n + 1)
        return self.doc[:size] == self.doc[n - 1 : n - 1 + size]


def find_words(raw: np.ndarray, bounds: np.ndarray, hashes: int = 1, lower: bool = False, gap: np.ndarray = _SPACE) -> Words:
    """Words of the texts of a buffer; ``lower`` takes A-Z as a-z, ``gap`` says which bytes part words."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(bounds), np.int64), np.zeros((hashes, 0), np.uint64))
    if lower:
        raw = _LOWER[raw]
    space = gap.take(raw)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = ~space
    ends = begins.copy()
    begins[1:] &= space[:-1] | edge[1:n]
    ends[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first := np.searchsorted(start, bounds)))
    found = np.zeros((hashes, len(start)), np.uint64)
    if len(start):
        length = np.diff(np.append(start, n))
        since = np.arange(start[0], n) - np.repeat(start, length)
        weight = powers(_BASE[0], int(length.max())).take(since)  # bytes between words count as 0
        for k in range(hashes):
            value = np.where(gap, np.uint64(0), _BYTE[k])
            found[k] = mix64(np.add.reduceat(value.take(raw[start[0] :]) * weight, start - start[0]))
    return Words(start, end, doc, first, found)


def pieces(bounds: np.ndarray, most: int):
    """Ranges of texts with about ``most`` bytes each, so that scratch arrays stay small; a longer text is a range alone."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
