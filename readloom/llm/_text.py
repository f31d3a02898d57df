"""Byte-level text primitives on Arrow columns, vectorised with NumPy.

Texts are padded with one space on either side, so that words and character
n-grams never reach from one document into the next.  A word class is a table
of 256 booleans; UTF-8 continuation and lead bytes are all >= 0x80, so classes
that treat non-ASCII characters alike can be decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE_LOWER = BYTE_CODE[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)

#: Runs of anything but ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Runs of ASCII letters, digits and non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers = np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        grown = np.full(size, _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


@dataclass
class Words:
    """Words of several documents; document i holds words first[i]:first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes of text each, or of one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of the texts, each between two spaces; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    blank = pa.scalar("", pa.large_string())
    column = pc.binary_join_element_wise(blank, column, blank, pa.scalar(" ", pa.large_string()))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each byte belongs to a word, and where words start and end."""
    inside = kind[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return inside, edge[0::2], edge[1::2]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """All words of padded texts with 64-bit hashes of their (lower-cased) bytes."""
    inside, starts, ends = spans(data, kind)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, offsets, starts, ends, first, np.zeros(0, np.uint64))
    sizes = ends - starts
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
    code = (BYTE_CODE_LOWER if lower else BYTE_CODE)[data[inside]]
    code *= _powers_to(int(sizes.max()))[within]
    hashes = np.add.reduceat(code, begins) + sizes.astype(np.uint64)
    return Words(data, offsets, starts, ends, first, mix(hashes))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; entry i covers words i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))


def text_words(texts: list[str | None], kind: np.ndarray, lower: bool = True) -> Words:
    """words() of a list of Python strings."""
    return words(*padded(pa.array(texts, pa.large_string())), kind, lower)
