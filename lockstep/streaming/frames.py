"""Trimming frames as they arrive: frames that carry their number need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import small


def trim_stream(frames: DataFrame, views: DataFrame) -> DataFrame:
    """A stream (view, n, ...) joined with the registry: frames at or past their view's offset, with frame_idx."""
    kept = frames.join(small(views.select("view", "offset")), "view").where(F.col("n") >= F.col("offset"))
    return kept.withColumn("frame_idx", (F.col("n") - F.col("offset")).cast("long")).drop("offset")


def count_stream(kept: DataFrame) -> DataFrame:
    """Running frame counts per view; for the update or complete output mode."""
    return kept.groupBy("view").agg(F.count("*").alias("frame_count"))
