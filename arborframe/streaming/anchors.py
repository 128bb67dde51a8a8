"""Anchoring a stream of annotations: each micro-batch is joined with the mesh, which doesn't change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotations as an


def anchor_stream(rows: DataFrame, vertex: DataFrame, folder: str, checkpoint: str, max_distance: float | None = None, **trigger) -> StreamingQuery:
    """Write anchored annotations to Parquet; a batch that runs again overwrites its own folder, so that each row is there once."""

    def batch(df: DataFrame, number: int) -> None:
        an.anchor(df, vertex, max_distance).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(rows: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Annotations per object and window of time; rows later than `late` are left out."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "mesh_id").agg(F.count("*").alias("n"))
