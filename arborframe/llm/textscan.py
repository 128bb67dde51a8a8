"""Vectorised word scanning over Arrow text columns.

Every word rule used by the operators of this package is decided by ASCII
characters alone (white space, or everything but digits and letters), so in
UTF-8 a word boundary is always a byte boundary. One batch of texts is scanned
as one byte array: a table look-up classifies the bytes, differences of the
classification give the word spans, and each word's 64-bit hash comes from its
pieces of eight bytes, mixed one by one. There is no Python loop over words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are maximal runs of anything but ASCII white space.
NON_SPACE = ~_SPACE
#: Words are maximal runs of ASCII digits, lower-case letters and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECES = 1 << 20
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words(NamedTuple):
    """Words of a batch. starts and ends are byte offsets into data."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    n_docs: int


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def scan(column: pa.Array | pa.ChunkedArray, kind: np.ndarray = ALNUM, lower: bool = True, hashed: bool = True) -> Words:
    """All words of a text column, with the row each belongs to."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Texts that touch without a separator: cut the words at the texts' ends.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, starts, ends, doc, _hashes(data, starts, ends) if hashed else np.empty(0, np.uint64), n)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the mixed pieces of eight bytes of each word, each salted by its place, mixed again with the word's length."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    pieces = (size + 7) >> 3
    before = np.cumsum(pieces) - pieces
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(before, before[i] + _PIECES)))
        n, first = pieces[i:j], before[i:j] - before[i]
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        at = np.repeat(starts[i:j], n) + 8 * place
        value = eight[at] & _LOW[np.minimum(np.repeat(ends[i:j], n) - at, 8)]
        value += (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        out[i:j] = np.add.reduceat(mix(value), first)
        i = j
    return mix(out + size.astype(np.uint64) * np.uint64(_BASE))


def first_of_doc(words: Words) -> np.ndarray:
    """Offsets of each row's words: row i has words first[i]:first[i + 1]."""
    return np.searchsorted(words.doc, np.arange(words.n_docs + 1))


def grams(words: Words, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a row and the index of each one's first word."""
    h = words.hashes
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += h[k : len(h) - n + 1 + k]
    first = np.flatnonzero(words.doc[: len(h) - n + 1] == words.doc[n - 1 :])
    return mix(out[first], seed), first


_CLASS = np.full(256, 3, np.int8)  # other signs
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2


def runs(column: pa.Array | pa.ChunkedArray) -> Words:
    """Runs of letters (and non-ASCII characters), of digits and of other signs, in their case."""
    data, offsets = utf8(column)
    kind = _CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edge = np.flatnonzero(change)
    starts, ends = edge[:-1], edge[1:]
    keep = kind[starts] != 0 if len(starts) else np.empty(0, bool)
    starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, starts, ends, doc, _hashes(data, starts, ends), len(offsets) - 1)
