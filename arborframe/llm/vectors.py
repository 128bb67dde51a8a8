"""Vectors of a list column as matrices, and sorted streams of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries, each row's first entry and length, and whether the row holds a vector without null or non-finite entries."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(values) if values.dtype.kind == "f" else null)])
    first = np.cumsum(size) - size
    return values, first, size, column.is_valid().to_numpy(zero_copy_only=False) & (bad[first + size] == bad[first])


def by_length(first: np.ndarray, size: np.ndarray, ok: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the rows that are ok: these rows, and the places of their entries as a matrix."""
    for n in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == n))
        yield rows, first[rows][:, None] + np.arange(n)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision whatever their size; rows of zeros stay."""
    x = x.astype(np.float64)
    x /= np.maximum(np.abs(x).max(1, initial=0, keepdims=True), np.finfo(float).tiny)
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), np.finfo(float).tiny)


def packed(column: pa.Array, kind: str) -> np.ndarray:
    """Binary rows of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def edges(table: pa.Table | pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Where each run of equal values of the columns begins, and the number of rows."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        x = table.column(c)
        new |= pc.not_equal(x.slice(1), x.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False) if n > 1 else False
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A stream in the order of columns (without nulls) in tables that break no group, with the groups' edges. A group has to fit in memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = edges(table, columns)
        if len(at) > 2:
            yield table.slice(0, at[-2]), at[:-1]
        held = table.slice(at[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, edges(table, columns)
