"""A corpus pipeline in five stages, each by one operator of arborframe.llm.

quality keeps the documents that the classifier accepts; near_duplicates keeps
one document of each class; decontamination removes the documents with words
in a benchmark window; mixing repeats or drops documents so that sources meet
their targets; sharding deals the rows into eight shards and adds shard and
slot. A stage works on all that the one before it kept.

Defined cases: a null text is one without words: the classifier judges it as it
does every text, no stage else drops it, and mixing gives it the copies of its
length class; rows that repeat in id and text are one document to near_duplicates;
very long texts are read whole by every stage; an empty table
stays empty; further columns of any name, those of results, with dots and
back-ticks included, go with their rows, and shard and slot get trailing underscores where
the table has columns of these names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arborframe.llm import decontamination, mixing, near_duplicates, quality, sharding
from arborframe.llm.common import quoted, set_checkpoint_dir, table

N_SHARDS = 8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*quoted(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixing.materialise(mixed, docs.columns, mixed.columns[-1])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, N_SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained network, hashed signatures and a keyed permutation are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder, and read again."""
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = _stored(spark, docs, name)
    return docs
