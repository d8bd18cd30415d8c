"""Frame alignment: number the frames of each view, drop its leading ones, renumber the rest from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, TimestampType

from ..functions.text import frame_name

#: A registry of so many views at most is broadcast; it is a literal table of the caller.
BROADCAST_VIEWS = 10_000
#: Rows from which the bounds of ranges are taken.
SAMPLE = 4096


def small(views: DataFrame) -> DataFrame:
    """The registry, for broadcasting where its size allows it."""
    return F.broadcast(views) if views.limit(BROADCAST_VIEWS + 1).count() <= BROADCAST_VIEWS else views


def ranges(frames: DataFrame, order: Sequence[str], parts: int | None = None) -> Column:
    """A number for each row that ascends with the order columns: one of at most `parts` ranges about equal in rows.

    Bounds come from SAMPLE rows, taken by a hash of the order columns; rows equal in these share a range. By default there are as
    many ranges as the session has shuffle partitions.
    """
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")) if parts is None else parts
    taken = frames.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLE)
    sorted_ = F.sort_array(F.collect_list(F.struct(*order)))
    size = F.size("s")
    picks = F.transform(F.sequence(F.lit(1), F.lit(max(parts - 1, 1))), lambda k: F.get("s", (k * size / max(parts, 1)).cast("int")))
    # as text, or microseconds, that is the same value when it is read back, whatever the time zones
    kinds = {f.name: f.dataType for f in frames.select(*order).schema}
    plain = lambda x, kind: F.unix_micros(x).cast("string") if kind == TimestampType() else F.hex(x) if kind == BinaryType() else x.cast("string")
    value = lambda x, kind: F.timestamp_micros(F.lit(x).cast("long")) if kind == TimestampType() else F.unhex(F.lit(x)) if kind == BinaryType() else F.lit(x).cast(kind)
    texts = F.transform(F.array_distinct(F.filter(picks, lambda x: x.isNotNull())), lambda x: F.array(*[plain(x[c], kinds[c]) for c in order]))
    found = taken.agg(sorted_.alias("s")).select(texts.alias("b")).first()["b"] if parts > 1 else []
    if not found:
        return F.lit(0)
    bounds = F.array(*[F.struct(*[value(x, kinds[c]).alias(c) for x, c in zip(row, order)]) for row in found])
    own = F.struct(*order)
    # a search by halves: how many bounds are not above the row
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(found).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= own, at + step).otherwise(at))


def number_frames(frames: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """frames with n, the frame's number from 0 within its view by the order columns.

    A view's frames are dealt by ranges of the order, not to one task: each range is numbered on its own, from the count of what
    the view has in the ranges before it.
    """
    placed = frames.withColumn("__part", ranges(frames, order, parts))
    counts = placed.groupBy("view", "__part").agg(F.count("*").alias("__n"))
    # a row per view and range
    before = Window.partitionBy("view").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("view").alias("__view"), F.col("__part").alias("__own"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    by_range = Window.partitionBy("view", "__part").orderBy(*order)
    numbered = placed.withColumn("__row", F.row_number().over(by_range))
    both = numbered.join(starts, F.col("view").eqNullSafe(F.col("__view")) & (F.col("__part") == F.col("__own")))
    n = (F.col("__start") + F.col("__row") - 1).cast("long").alias("n")
    return both.select(*[numbered[c] for c in frames.columns], n)


def trim(numbered: DataFrame, views: DataFrame) -> DataFrame:
    """The frames with n at or past their view's offset, with frame_idx; views that aren't registered go."""
    own = small(views.select("view", "offset"))
    kept = numbered.join(own, "view").where(F.col("n") >= F.col("offset"))
    # offsets are not negative and n is gapless, so n - offset is gapless from 0 without a second window
    return kept.withColumn("frame_idx", (F.col("n") - F.col("offset")).cast("long")).drop("offset")


def frame_index(inspection: DataFrame, views: DataFrame) -> DataFrame:
    """(view, src_frame, frame_idx, file_name) from header counts alone; no frame is read.

    inspection: view and nb_frames, which may be text; counts that aren't numbers give no frames, and an
    offset past the end leaves none.
    """
    both = inspection.select("view", F.col("nb_frames").cast("string").try_cast("long").alias("nb")).join(small(views.select("view", "offset")), "view")
    # an ascending sequence only: past the end it would count down
    kept = both.where(F.col("nb") > F.col("offset"))
    rows = kept.select("view", "offset", F.explode(F.sequence(F.col("offset").cast("long"), F.col("nb") - 1)).alias("src_frame"))
    index = (F.col("src_frame") - F.col("offset")).alias("frame_idx")
    return rows.select("view", "src_frame", index).withColumn("file_name", frame_name(F.col("frame_idx")))


def frame_counts(frames: DataFrame, views: DataFrame, where: Column | None = None) -> DataFrame:
    """The registry with frame_count; views without frames count 0."""
    counted = (frames if where is None else frames.where(where)).groupBy("view").agg(F.count("*").alias("c"))
    return views.join(counted, "view", "left").select(*[views[c] for c in views.columns], F.coalesce("c", F.lit(0)).cast("long").alias("frame_count"))


def kept_counts(frames: DataFrame, views: DataFrame) -> DataFrame:
    """The registry with frame_count, the frames that trimming leaves: what a view has beyond its offset. Nothing is numbered."""
    counted = frames.groupBy("view").agg(F.count("*").alias("c"))
    left = F.greatest(F.coalesce("c", F.lit(0)) - F.col("offset"), F.lit(0)).cast("long").alias("frame_count")
    return views.join(counted, "view", "left").select(*[views[c] for c in views.columns], left)


def aligned_full(kept: DataFrame, views: Sequence[str], value: str, suffix: str) -> DataFrame:
    """A row per frame_idx that any view has, with each view's value; one scan, no self-join."""
    picks = [F.max(F.when(F.col("view") == v, F.col(value))).alias(f"{v}_{suffix}") for v in views]
    return kept.where(F.col("view").isin(*views)).groupBy("frame_idx").agg(*picks)


def aligned(kept: DataFrame, views: Sequence[str], value: str, suffix: str) -> DataFrame:
    """The rows of aligned_full in which every view has a frame."""
    return aligned_full(kept, views, value, suffix).dropna(subset=[f"{v}_{suffix}" for v in views])


def write_by_frame(kept: DataFrame, table: str, buckets: int) -> DataFrame:
    """kept as a table with buckets of frame_idx: views are aligned in it, by `aligned` and `aligned_full`, without a shuffle.

    Rows are dealt to the buckets before they are written, so that there is a file for each, sorted. The table is replaced; its files lie in
    the session's warehouse, which all executors share.
    """
    kept.repartition(buckets, "frame_idx").write.bucketBy(buckets, "frame_idx").sortBy("frame_idx", "view").mode("overwrite").format("parquet").saveAsTable(table)
    return kept.sparkSession.table(table)


def aligned_by_frame(table: DataFrame, views: Sequence[str], value: str, suffix: str) -> DataFrame:
    """`aligned` of a table of `write_by_frame`, as joins of its views: each is a scan of the same buckets, so none is shuffled or sorted anew."""
    own = [table.where(F.col("view") == v).select("frame_idx", F.col(value).alias(f"{v}_{suffix}")) for v in views]
    out = own[0]
    for other in own[1:]:
        out = out.hint("merge").join(other, "frame_idx")
    return out


def trim_groups(frames: DataFrame, group: str, number: str, offset: Column) -> DataFrame:
    """Frames that carry their number, trimmed by an offset computed per group; no join, no shuffle."""
    return frames.where(F.col(number) >= offset).withColumn("frame_idx", (F.col(number) - offset).cast("long"))
