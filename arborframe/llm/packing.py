"""Packed arrays, and their exchange between slices of texts and partitions of words.

A task reads its texts in slices. What a slice says about its distinct words is
dealt by word into partitions, as one packed row for each of both; a partition
answers a slice in the order of the slice's words, so that no word is sent back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD

from .common import trim
from .textscan import mix


def small(x: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds all values."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _plane(x) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T) if x.size else np.empty(0, np.uint8)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed block, byte plane by byte plane."""
    made = pickle.dumps([(str(x.dtype), x.shape, _plane(np.ascontiguousarray(x))) for x in arrays], protocol=5)
    return pa.compress(made, codec="zstd", asbytes=True) + len(made).to_bytes(8, "little")


def unpack(blob: bytes) -> list[np.ndarray]:
    made = pickle.loads(pa.decompress(blob[:-8], decompressed_size=int.from_bytes(blob[-8:], "little"), codec="zstd", asbytes=True))
    return [np.ascontiguousarray(p.T).view(t).reshape(shape) if p.size else np.zeros(shape, t) for t, shape, p in made]


def pack_sorted(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys, whose leading zeros compress."""
    return np.diff(keys, prepend=np.uint64(0))


def unpack_sorted(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed integers as small unsigned ones."""
    x = x.astype(np.int64, copy=False)
    return small(((x << 1) ^ (x >> 63)).view(np.uint64))


def unzigzag(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def pack_rows(keys: np.ndarray, rows: np.ndarray) -> bytes:
    """Ascending keys and a row of few entries other than 0 for each: their numbers, places and values."""
    at, place = np.nonzero(rows)
    return pack(pack_sorted(keys), small(np.bincount(at, minlength=len(keys))), small(place), zigzag(rows[at, place]))


def unpack_rows(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys, many, place, value = unpack(blob)
    rows = np.zeros((len(keys), width), np.int64)
    rows[np.repeat(np.arange(len(keys)), many.astype(np.int64)), place] = unzigzag(value)
    return unpack_sorted(keys), rows


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return (mix(words, 9) % np.uint64(parts)).astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct ascending keys by their partition (ascending in it), and each partition's edge in it."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they are there."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


def _same(p: int) -> int:
    return p


def deal(rows: RDD, parts: int) -> RDD:
    """Rows (partition, row) to their partitions: a shuffle that later jobs read again."""
    return rows.partitionBy(parts, _same)


def kinds(rows: Iterator, f) -> Iterator:
    """f(partition, rows by kind) of the partitions in a task; a row's kind is its first field."""
    by: dict[int, dict[str, list]] = {}
    for p, x in rows:
        by.setdefault(p, {}).setdefault(x[0], []).append(x)
    for p in list(by):
        yield from f(p, by.pop(p))
        trim()


class Uneven(RuntimeError):
    """A slice was read twice and differed."""
