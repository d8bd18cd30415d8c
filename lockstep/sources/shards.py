"""Packed frames: images end to end in large files, with a table of where each lies.

For stores that bear no small files. Every task writes shards of its own, under names of its own, and the rows of the table name those of
tasks that ended well: what a lost or repeated task leaves is in no row. A frame is found by its view and number, and read by one ranged read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import small
from .frames import _store, openable, opened

INDEX = "view string, frame_idx long, shard string, at long, size long"
#: Bytes of a shard, about, and of images in a batch.
SHARD, BATCH = 256 << 20, 8 << 20


def write_shards(frames: DataFrame, path: str, shard: int = SHARD) -> None:
    """frames (view, frame_idx, image) as path/data/*.bin and the table path/index, which is written over.

    Rows that are near in a task are near in a shard: sort or range frames beforehand if they will be read so. Null images are empty ones.
    """
    if not openable(path):
        raise ValueError(f"tasks can't write to {path}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = _store(f"{path}/data")
        store.create_dir(home, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                held = []
                for view, k, image in zip(*(batch.column(c) for c in range(3))):
                    data = image.as_py() or b""
                    if out is None or at >= shard:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.bin", 0
                        out = store.open_output_stream(f"{home}/{name}")
                    out.write(data)
                    held.append((view.as_py(), k.as_py(), name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["view", "frame_idx", "shard", "at", "size"])
        finally:
            if out:
                out.close()

    frames.select("view", "frame_idx", "image").mapInArrow(run, INDEX).write.mode("overwrite").partitionBy("view").parquet(f"{path}/index")


def shard_index(spark: SparkSession, path: str) -> DataFrame:
    """The table of packed frames; conditions on view and frame_idx prune its files."""
    return spark.read.schema("frame_idx long, shard string, at long, size long, view string").parquet(f"{path}/index").select("view", "frame_idx", "shard", "at", "size")


def read_shards(found: DataFrame, path: str) -> DataFrame:
    """(view, frame_idx, image) of some rows of `shard_index`: a ranged read for each, shard by shard in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if file:
                        file.close()
                    file, name = opened(f"{path}/data/{row['shard']}"), row["shard"]
                file.seek(row["at"])
                held.append((row["view"], row["frame_idx"], file.read(row["size"])))
                size += row["size"]
                if size >= BATCH:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)
        if file:
            file.close()

    return found.sortWithinPartitions("shard", "at").mapInArrow(run, "view string, frame_idx long, image binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.int64(), pa.binary()))], ["view", "frame_idx", "image"])


def frames_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The packed frames of wanted (view, frame_idx), each once."""
    own = wanted.select("view", "frame_idx").distinct()
    return read_shards(shard_index(spark, path).join(small(own), ["view", "frame_idx"]), path)
