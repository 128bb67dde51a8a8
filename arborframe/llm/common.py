"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder of spark.checkpoint.dir; a local one only where there is none and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="arborframe-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores appended until no column has it (case aside)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def quoted(names: list[str]) -> list[Column]:
    """Columns of any name, dots and back-ticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def any_names(*arguments: str) -> Callable:
    """For an operator on a table, whose arguments of these names are columns of it: it never sees a name with a dot or a back-tick in it.

    Such columns have another name while it runs, and their own in its result.
    """

    def wrap(operator: Callable) -> Callable:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            odd = [c for c in df.columns if "." in c or "`" in c]
            if not odd:
                return operator(df, *args, **options)
            inner: dict[str, str] = {}
            for i, c in enumerate(odd):
                inner[c] = free_name([*df.columns, *inner.values()], f"column_{i}")
            call = signature.bind(df, *args, **options)
            call.apply_defaults()
            call.arguments[next(iter(signature.parameters))] = df.toDF(*[inner.get(c, c) for c in df.columns])
            for a in arguments:
                call.arguments[a] = inner.get(call.arguments[a], call.arguments[a])
            out, own = operator(*call.args, **call.kwargs), {v: k for k, v in inner.items()}
            return out.toDF(*[own.get(c, c) for c in out.columns])

        return run

    return wrap


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of like size, max_bytes of text at most but one row at least: nothing is left out."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    whole = int(lengths.sum())
    max_bytes = whole / max(1, -(-whole // max_bytes))
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield batch.slice(start)
    del batch, lengths
    trim()


def bitmap(rows: DataFrame, column: Column) -> DataFrame:
    """A bitmap of FILTER_BITS bits (8 MB) of the column's hashes, in rows of 4 KB: what the filter of maybe_in is."""
    at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
    return cut(rows.groupBy(F.bitmap_bucket_number(at).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits")))


def maybe_in(rows: DataFrame, column: Column, bits: DataFrame, name: str) -> DataFrame:
    """Append a boolean that is true for all values of which bits was made, and for few others (for all, once the bitmap is full)."""
    at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
    place = F.bitmap_bit_position(at)
    part, held = free_name(rows.columns, "__part"), free_name(rows.columns, "__bits")
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
    joined = rows.join(F.broadcast(bits.select(F.col("__part").alias(part), F.col("__bits").alias(held))), F.bitmap_bucket_number(at) == F.col(part), "left")
    return joined.withColumn(name, hit).drop(part, held)
