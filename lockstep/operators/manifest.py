"""The two manifests: per-source inspection and per-view alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, note, resolution, time_offset, value_of
from .registry import FPS

INSPECTION = "view string, filename string, codec_name string, width string, height string, r_frame_rate string, duration_sec string, nb_frames string"
ALIGNMENT = "view string, fps double, frame_offset int, time_offset_sec double, resolution string, frame_count long, notes string"
#: Keys of a probe's text, and the column that each fills.
PROBE_KEYS = {"codec_name": "codec_name", "width": "width", "height": "height", "r_frame_rate": "r_frame_rate", "duration": "duration_sec", "nb_frames": "nb_frames"}
#: Empty texts are written as nothing, quotes doubled.
CSV = {"header": True, "emptyValue": "", "escape": '"', "quote": '"'}


def parse_probe(probed: DataFrame, text: str = "text") -> DataFrame:
    """probed with a text column per probe key, empty where the key is missing; the last of repeated keys holds."""
    with_lines = probed.withColumn("__lines", lines(F.col(text)))
    return with_lines.withColumns({name: value_of(F.col("__lines"), key) for key, name in PROBE_KEYS.items()}).drop("__lines")


def inspection(parsed: DataFrame, views: DataFrame) -> DataFrame:
    """A row per registered view, in the registry's order; views without a header have empty fields."""
    own = views.select("position", "view", F.col("source").alias("filename"))
    out = own.join(parsed.drop("filename"), "view", "left").orderBy("position")
    return out.select("view", "filename", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PROBE_KEYS.values()])


def reference_resolution(inspected: DataFrame, reference: str) -> DataFrame:
    """One row: the reference view's WxH; null if it has none. It is for all rows, whatever other views measure."""
    size = F.when((F.col("width") != "") & (F.col("height") != ""), resolution(F.col("width"), F.col("height")))
    return inspected.where(F.col("view") == reference).agg(F.first(size).alias("resolution"))


def alignment(counts: DataFrame, resolutions: Column | DataFrame, reference: str, fps: float = FPS) -> DataFrame:
    """The alignment manifest of counts (position, view, offset, frame_count), in the registry's order."""
    if isinstance(resolutions, DataFrame):
        counts = counts.crossJoin(F.broadcast(resolutions))  # an aggregate without keys: one row
    else:
        counts = counts.withColumn("resolution", resolutions)
    return counts.orderBy("position").select(
        "view", F.lit(float(fps)).alias("fps"), F.col("offset").alias("frame_offset"),
        time_offset(F.col("offset"), fps).alias("time_offset_sec"), "resolution",
        F.col("frame_count").cast("long").alias("frame_count"), note(F.col("offset"), reference).alias("notes"),
    )


def consistency(inspected: DataFrame, counts: DataFrame, fps: float = FPS) -> DataFrame:
    """Per view: whether frames are what the header and the offset say, and whether duration and rate agree."""
    number = lambda c, kind: F.col(c).cast("string").try_cast(kind)
    rate = F.split("r_frame_rate", "/")
    probed = F.try_divide(F.try_element_at(rate, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(rate, F.lit(2)).try_cast("double"), F.lit(1.0)))
    both = counts.join(inspected.select("view", number("nb_frames", "long").alias("nb_frames"), number("duration_sec", "double").alias("duration"), probed.alias("rate")), "view", "left")
    return both.select(
        "view", "nb_frames", F.col("offset").alias("frame_offset"), "frame_count",
        (F.greatest(F.col("nb_frames") - F.col("offset"), F.lit(0)) == F.col("frame_count")).alias("consistent"),
        (F.col("nb_frames") / F.lit(float(fps)) == F.col("duration")).alias("duration_agrees"), (F.col("rate") == F.lit(float(fps))).alias("rate_agrees"),
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One CSV file in row order; what was there is replaced. A manifest has a row per view.

    A path that ends in .csv is the file itself, put there when it is whole; any other is a folder with the file in it.
    """
    if not path.endswith(".csv"):
        manifest.coalesce(1).write.mode("overwrite").options(**CSV).csv(path)
        return
    spark = manifest.sparkSession
    folder, _, name = path.rpartition("/")
    aside = f"{folder or '.'}/.{name}.{uuid.uuid4().hex}"
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = at(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        manifest.coalesce(1).write.options(**CSV).csv(aside)
        made = store.globStatus(at(f"{aside}/part-*"))[0].getPath()
        store.delete(at(path), True)
        if not store.rename(made, at(path)):
            raise OSError(f"{path} could not be written")
    finally:
        store.delete(at(aside), True)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest with its declared types: probed fields stay text, missing ones empty, not null."""
    found = spark.read.schema(schema).options(**CSV).csv(path)
    return found.fillna("")
