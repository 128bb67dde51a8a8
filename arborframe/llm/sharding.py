"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number is its place in a fixed order of the whole table: first by a
hash bucket of (key, text), then by key and content within the bucket. The
permutation sends row number r of n to p; the shard is p mod k and the slot is
p div k, so shards differ by one row at most, slots have no gaps, and either
can be computed (or inverted) from the row number alone.

Defined cases: null keys and null texts are ordinary values; a very long text
is one row as any other; rows that repeat in key and text are numbered next to
each other, in the order of their other columns (rows equal in all columns are
one bucket's, and can't be told apart in the result); an empty table gives an empty
result; a column of the table that is named as a result keeps its name, and
the result gets a trailing underscore.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import any_names, free_name
from .textscan import mix

ROUNDS = 6
MIN_BUCKETS, MAX_BUCKETS = 4096, 1 << 20


class Feistel:
    """A keyed permutation of 0..n-1 and its inverse, on numpy arrays."""

    def __init__(self, n: int, seed: int):
        self.n, self.seed = n, seed
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, x: np.ndarray, k: int) -> np.ndarray:
        return mix(x, self.seed * ROUNDS + k) & self.mask

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in range(ROUNDS):
            if inverse:
                left, right = right ^ self._round(left, ROUNDS - 1 - k), left
            else:
                left, right = right, left ^ self._round(right, k)
        return left << h | right

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        """Apply the permutation of the power-of-two domain until the value is below n."""
        out = np.asarray(x).astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = self._once(out[todo], inverse)
            todo = todo[out[todo] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def row_numbers(df: DataFrame, key: str, text: str, name: str, rows_per_bucket: int = 100_000) -> tuple[DataFrame, int]:
    """Append global row numbers 0..n-1 and return n.

    A first job counts the rows of each hash bucket (about rows_per_bucket rows
    each, at most MAX_BUCKETS counts come to the driver); the second numbers the
    rows within their bucket and adds the rows of the buckets before it.
    """
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, df.count() // rows_per_bucket))
    bucket = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(buckets)).cast("int")
    counts = {r[0]: r[1] for r in df.groupBy(bucket.alias("b")).count().collect()}
    before = np.concatenate([[0], np.cumsum([counts.get(b, 0) for b in range(buckets)])]).tolist()
    b, row = free_name(df.columns, "__bucket"), free_name(df.columns, "__row")
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(before[:-1])), f"{b} int, {row} long"))
    rest = [F.col(c).asc_nulls_first() for c in sorted(df.columns) if c not in (key, text) and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    order = Window.partitionBy(b).orderBy(F.col(key).asc_nulls_first(), F.xxhash64(F.col(text), F.col(key)), F.crc32(F.col(text).cast("binary")), *rest)
    numbered = df.withColumn(b, bucket).withColumn(name, (F.row_number().over(order) - 1).cast("long"))
    return numbered.join(offsets, b).withColumn(name, F.col(name) + F.col(row)).drop(b, row), before[-1]


def permuted(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf(T.LongType())
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, seed).forward(x.to_numpy()))

    return apply(number)


@any_names("key", "text")
def assign_shards(df: DataFrame, n_shards: int = 8, seed: int = 20240607, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of df, with shard (int) and slot (long)."""
    number = free_name(df.columns, "__number")
    shard, slot = free_name(df.columns, "shard"), free_name(df.columns, "slot")
    numbered, n = row_numbers(df, key, text, number)
    return (
        numbered.withColumn(number, permuted(F.col(number), n, seed))
        .withColumns({shard: (F.col(number) % n_shards).cast("int"), slot: F.floor(F.col(number) / n_shards).cast("long")})
        .drop(number)
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.col("text").cast("binary")
    facts = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.sha2(raw, 256).alias("__digest"),
    )
    return assign_shards(facts, text="__digest").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
