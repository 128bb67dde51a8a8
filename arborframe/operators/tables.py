"""Conventions shared by the operators.

Vertices keep their ids for good: a mask is a set of ids and never renumbers.
Missing is NULL inside; `or_minus_one` makes the -1 of outside formats.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NONSENSE_DIGITS = 100
FEW = 100_000  # so many rows of a few numbers, counted, are broadcast


class EmptyMaskError(ValueError):
    """A mask that keeps no vertex."""


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the session names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="arborframe-checkpoint-")
        sc.setCheckpointDir(shared)
    # Spark 4.1 gives a union the partitioning of its sides if these agree. A checkpoint still claims its plan's, but its partitions
    # may have been coalesced: rows of one key then stay apart, without a shuffle and without an error.
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    done = df.checkpoint(eager=True)
    # A checkpoint keeps its plan's estimate of size, which each join multiplies: after rounds of self-joins it has
    # millions of digits, and planning takes longer than the jobs. Such a one is dropped, with the plan that has it.
    digits = re.search(r"E\+(\d+)", done._jdf.queryExecution().optimizedPlan().stats().toString())
    if digits is None or int(digits[1]) < _NONSENSE_DIGITS:
        return done
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), session)


def few(df: DataFrame) -> DataFrame:
    """df, a row an object, to be joined by the object alone: broadcast if its rows, counted, are few, so that a large object isn't one task.

    Spark itself doesn't: a side with one key fills few partitions, for which adaptive execution takes the broadcast back.
    """
    done = cut(df)
    return F.broadcast(done) if done.count() <= FEW else done.hint("merge")


def or_minus_one(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(-1))


def dense_index(df: DataFrame, by: str, key: str, name: str = "dense") -> DataFrame:
    """Positions 0.. of the rows of each object in the order of their id."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1)
