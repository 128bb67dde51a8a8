"""Whitening of embeddings: moments by Chan's merging, eigenvectors, a second pass that verifies.

1. Fit. Each partition computes, for its vectors, their number, mean and centred
   scatter; treeReduce merges two such triples by
   n = n1 + n2, mean = mean1 + d n2 / n, scatter = scatter1 + scatter2 + d d' n1 n2 / n
   with d = mean2 - mean1, so no large numbers are subtracted from each other,
   however far from zero the vectors lie. Vectors of whole numbers carry exact
   sums besides. A partition keeps one matrix, as do the driver and each merge.
2. The driver takes eigenvectors of scatter / n (divisor n). A component is given
   if its eigenvalue is above DEGENERATE of the largest; so constant
   dimensions and tables with fewer vectors than dimensions give fewer.
3. Check. A second pass whitens all vectors and takes the covariance of the
   result, by the same merging; its largest absolute difference from the identity is the identity error.

Defined cases: rows whose vector is null, empty or holds null or non-finite
entries are dropped. Vectors of each length are a fit of their own (the number of
lengths is expected to be small: the driver holds one matrix for each). A
single vector, or equal ones, have no component, hence no row. Rows that repeat
count as often as they occur; a null key is kept; ties of eigenvalues are in
eigh's order. Whole numbers beyond 64 bits are cut to the range by Spark's cast; a deviation beyond 64 bits
is null. An empty table gives an empty result. Further columns are not read;
a result named like the key gets a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted
from .vectors import by_length, ragged

DEGENERATE = 1e-12
SLICE = 4096


class Moments(NamedTuple):
    """n vectors' mean and centred scatter; total: exact sums, of whole numbers only."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    total: list[int] | None


class Fit(NamedTuple):
    """What whitens vectors of one length: (x - mean) @ axes."""

    n: int
    mean: np.ndarray
    total: list[int] | None
    values: np.ndarray
    trace: float
    axes: np.ndarray


def moments(x: np.ndarray) -> Moments:
    """Of the rows of x."""
    whole = x.dtype.kind == "i"
    start = x[0]
    from_start = (x - start if not whole or np.abs(x).max() < 2**61 else x.astype(object) - start.astype(object)).astype(np.float64)
    shift = from_start.mean(0)
    from_start -= shift
    total = [int(s) for s in (x.sum(0) if np.abs(x).max(initial=0) * len(x) < 2**62 else x.astype(object).sum(0))] if whole else None
    return Moments(len(x), start.astype(np.float64) + shift, from_start.T @ from_start, total)


def merged(a: Moments, b: Moments) -> Moments:
    n = a.n + b.n
    d = b.mean - a.mean
    total = [s + t for s, t in zip(a.total, b.total, strict=True)] if a.total is not None and b.total is not None else None
    return Moments(n, a.mean + d * (b.n / n), a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / n), total)


def _both(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return a | {k: merged(a[k], m) if k in a else m for k, m in b.items()}


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batch, rows and their matrix, by length and in slices of SLICE rows."""
    for batch in batches:
        values, first, size, ok = ragged(batch.column("vec"))
        for rows, at in by_length(first, size, ok & (size > 0)):
            for i in range(0, len(rows), SLICE):
                yield batch, rows[i : i + SLICE], values[at[i : i + SLICE]]


def _vectors(df: DataFrame, vector: str | Column) -> Column:
    column = quoted([vector])[0] if isinstance(vector, str) else vector
    kind = df.select(column).schema[0].dataType.elementType.typeName()
    return column.cast("array<bigint>" if kind in ("byte", "short", "integer", "long") else "array<double>").alias("vec")


def column_moments(df: DataFrame, vector: str | Column, axes: dict[int, Fit] | None = None) -> dict[int, Moments]:
    """Moments of the vectors by their length; of the whitened ones, if axes are given."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for _, _, x in _matrices(batches):
            n = x.shape[1]
            if axes is not None:
                if n not in axes:
                    continue
                x = whitened(x, axes[n])
            found = _both(found, {n: moments(x)})
        for n, m in found.items():
            yield pa.RecordBatch.from_pydict({"size": [n], "n": [m.n], "mean": [m.mean.tobytes()], "scatter": [m.scatter.tobytes()], "total": [None if m.total is None else list(map(str, m.total))]}, pa.schema([("size", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary()), ("total", pa.list_(pa.string()))]))

    rows = df.select(_vectors(df, vector)).mapInArrow(local, "size int, n long, mean binary, scatter binary, total array<string>").rdd

    def triple(r) -> dict[int, Moments]:
        mean = np.frombuffer(r["mean"])
        return {r["size"]: Moments(r["n"], mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1), None if r["total"] is None else [int(s) for s in r["total"]])}

    # an empty partition has nothing to merge, and an empty table no triple at all
    return rows.map(triple).treeAggregate({}, _both, _both, depth=3)


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """x less the mean; of whole numbers (n x - sums) / n, whose numerator is exact."""
    return deviations(x, fit).astype(np.float64) / fit.n if fit.total is not None else x - fit.mean


def deviations(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n x - sums, exact, in Python's integers where 64 bits might not do."""
    total = np.array(fit.total, object)
    near = max(abs(s) for s in fit.total) < 2**61 and int(np.abs(x).max(initial=0)) * fit.n < 2**61
    return x * fit.n - total.astype(np.int64) if near else x.astype(object) * fit.n - total


def square_sums(d: np.ndarray) -> list[int | None]:
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**63:
        return (d**2).sum(1).tolist()
    sums = [int(s) for s in (d.astype(object) ** 2).sum(1)]
    return [s if s < 2**63 else None for s in sums]


def whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return centred(x, fit) @ fit.axes


def fit(df: DataFrame, vector: str | Column, components: int = 32) -> dict[int, Fit]:
    """For each length of vectors, the mean and up to `components` whitening axes, by falling eigenvalue."""
    out = {}
    for size, m in column_moments(df, vector).items():
        values, axes = np.linalg.eigh(m.scatter / m.n)
        values, axes = values[::-1], axes[:, ::-1]
        keep = np.flatnonzero(values > DEGENERATE * max(values[0], 0.0))[:components] if values[0] > 0 else np.empty(0, int)
        out[size] = Fit(m.n, m.mean, m.total, values[keep], float(np.trace(m.scatter) / m.n), axes[:, keep] / np.sqrt(values[keep]))
    return out


def identity_error(df: DataFrame, vector: str | Column, fits: dict[int, Fit]) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over all rows again; null if nothing is whitened."""
    again = column_moments(df, vector, {k: f for k, f in fits.items() if len(f.values)})
    return max((float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max()) for m in again.values()), default=None)


def whiten(df: DataFrame, vector: str | Column = "embedding", key: str = "vec_id", components: int = 32) -> DataFrame:
    """One row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    deviation is the sum over dimensions of (n x - sum)^2, exact, for vectors of whole numbers, else null.
    """
    fits = fit(df, vector, components)
    error = identity_error(df, vector, fits)
    names = [key, *[free_name([key], c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in _matrices(batches):
            f = fits[x.shape[1]]
            k, m = len(f.values), len(rows)
            if k:
                far = square_sums(deviations(x, f)) if f.total is not None else [None] * m
                at = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    batch.column("key").take(pa.array(rows)).take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, f.n), pa.int64()), pa.array(far, pa.int64()).take(at),
                    pa.array(whitened(x, f).ravel()), pa.array(np.tile(f.values / f.trace, m)), pa.array(np.full(m * k, np.nan if error is None else error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *"bcdefg"])

    rows = df.select(quoted([key])[0].alias("key"), _vectors(df, vector))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, b int, c long, d long, e double, f double, g double"
    return rows.mapInArrow(run, schema).toDF(*names)


def scaled(vector: str, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Entries c as whole numbers floor(scale c) + shift; null where the vector is to be dropped."""
    v = quoted([vector])[0]
    whole = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(v.isNotNull() & whole, F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift)))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scaled("embedding"))
