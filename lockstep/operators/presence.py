"""Which frames of a view are there: bitmaps of frame numbers that merge, their runs, and the gaps between them.

A view's frames are a row per 32,768 numbers, made by aggregation; indexes of several listings, or of the same one taken in parts, merge into
one. Runs and gaps come from the bitmaps, a row's own first, then joined where rows meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import small

#: Numbers that a row's bitmap stands for, as Spark's bitmap functions have it.
ROW = 32_768


def presence(numbered: DataFrame, number: str = "frame_idx") -> DataFrame:
    """(view, row, bits) of numbered (view, frame_idx): bit k of a row is frame row * 32,768 + k. Nulls and negative numbers are left out, repeated ones count once."""
    own = numbered.where(F.col("view").isNotNull() & (F.col(number) >= 0))
    row = F.expr(f"{number} div {ROW}").alias("row")
    return own.groupBy("view", row).agg(F.expr(f"bitmap_construct_agg({number} % {ROW})").alias("bits"))


def merged(*indexes: DataFrame) -> DataFrame:
    """One presence index of several."""
    both = indexes[0]
    for other in indexes[1:]:
        both = both.unionByName(other)
    return both.groupBy("view", "row").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def counts(index: DataFrame) -> DataFrame:
    """(view, frame_count): different frames by view."""
    return index.groupBy("view").agg(F.sum(F.expr("bitmap_count(bits)")).cast("long").alias("frame_count"))


def _row_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for view, row, bits in zip(*(batch.column(k).to_pylist() for k in range(3))):
            edge = np.diff(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(np.int8), prepend=0, append=0)
            first, last = (np.flatnonzero(edge == sign) + row * ROW for sign in (1, -1))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(view, pa.string()), len(first)), pa.array(first), pa.array(last - 1)], ["view", "first", "last"])


def runs(index: DataFrame) -> DataFrame:
    """(view, first, last): longest runs of frames that are there. Runs that meet where two rows do are joined; few rows per view, not its frames, come together."""
    found = index.mapInArrow(_row_runs, "view string, first long, last long")
    by_view = Window.partitionBy("view").orderBy("first")
    marked = found.withColumn("begins", (F.col("first") > F.coalesce(F.lag("last").over(by_view) + 1, F.lit(-1))).cast("long"))
    numbered = marked.withColumn("run", F.sum("begins").over(by_view.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("view", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def gaps(index: DataFrame, expected: DataFrame) -> DataFrame:
    """(view, first, last): the runs of frames below expected (view, frame_count) that are not there. Views without any have one gap, the whole."""
    end = small(expected.where("frame_count > 0").select("view", F.col("frame_count").alias("until")))
    held = runs(index).join(end.select("view"), "view", "left_semi")
    # past the last frame, a run of nothing
    edges = held.select("view", "first", "last").unionByName(end.select("view", F.col("until").alias("first"), F.col("until").alias("last")))
    before = F.max("last").over(Window.partitionBy("view").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    open_ = edges.withColumn("after", F.coalesce(before + 1, F.lit(0))).join(end, "view")
    found = open_.select("view", F.col("after").alias("first"), (F.least("first", "until") - 1).alias("last"))
    return found.where("first <= last")


def missing(wanted: DataFrame, index: DataFrame, number: str = "frame_idx") -> DataFrame:
    """The rows of wanted (view, frame_idx, ...) that are not in the index. An index has a row per 32,768 frames: it is what is sent, not names."""
    own = index.select(F.col("view").alias("__view"), F.col("row").alias("__row"), "bits")
    at = F.expr(f"{number} % {ROW}")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.expr("shiftright(__byte, cast(__at % 8 as int))").bitwiseAND(1) == 1, F.lit(False))
    both = wanted.join(own, (F.col("view") == F.col("__view")) & (F.expr(f"{number} div {ROW}") == F.col("__row")), "left")
    return both.withColumn("__at", at).withColumn("__byte", byte).where(~there).select(*wanted.columns)
