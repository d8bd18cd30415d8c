"""Frame files on disk: listing, counting, reading and writing."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frame_name, is_frame_name

LISTED = "view string, file_name string, length long"
#: Names that a listing task hands on at once.
NAMES = 10_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def list_frames(spark: SparkSession, data: str) -> DataFrame:
    """(view, file_name, length) of the frames in the folders under data; only names are read. No folder, no rows.

    Each folder is listed by a task of its own and its names leave in batches; the driver sees the folders only. A folder whose name begins with a full stop
    is someone's work in progress. Where tasks can't list, Spark's reader does, on the driver.
    """
    if not exists(spark, data):
        return spark.createDataFrame([], LISTED)
    if not openable(data):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "frame_*.jpg").load(data)
        return listed(files.select("path", "length"))
    folders = [f"{data}/{name}" for name in _folders(data)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for found in _names(folders[k]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64()))], ["path", "length"])

    return listed(spark.range(0, len(folders), 1, max(len(folders), 1)).mapInArrow(run, "path string, length long"))


def _folders(data: str) -> list[str]:
    from pyarrow import fs

    store, home = _store(data)
    found = store.get_file_info(fs.FileSelector(home))
    return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith("."))


def _names(folder: str) -> Iterator[list[tuple[str, int]]]:
    """(path, size) of the files in a folder and those below it, in batches."""
    from pyarrow import fs

    store, home = _store(folder)
    if isinstance(store, fs.LocalFileSystem):
        # a scan that holds no list
        found = ((f.path, f.stat().st_size) for top, _, _ in os.walk(home) for f in os.scandir(top) if f.is_file())
    else:
        found = ((x.path, x.size) for x in store.get_file_info(fs.FileSelector(home, recursive=True)) if x.type == fs.FileType.File)
    while some := list(itertools.islice(found, NAMES)):
        yield some


def listed(files: DataFrame) -> DataFrame:
    """(view, file_name, length) of those of files (path, length) that are frames; a frame's folder is its view."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select(F.element_at(parts, -2).alias("view"), name.alias("file_name"), "length").where(is_frame_name(F.col("file_name")))


def write_frame_table(frames: DataFrame, path: str) -> None:
    """(view, frame_idx, image) as Parquet by view, each with its file name: for stores without folders of small files."""
    frames.withColumn("file_name", frame_name(F.col("frame_idx"))).write.mode("overwrite").partitionBy("view").parquet(path)


#: Stores that a task opens by path; plain paths are local or mounted.
STORES = ("", "file", "hdfs", "s3", "s3a", "gs")


def openable(path: str) -> bool:
    return (path.partition("://")[0] if "://" in path else "file" if path.startswith("file:") else "") in STORES


def _store(path: str):
    """(file system, path in it) of a path that Spark would take."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(f"s3{path[3:]}" if path.startswith("s3a:") else path)


def opened(path: str) -> BinaryIO:
    """A file opened for reading at any place."""
    store, at = _store(path)
    return store.open_input_file(at)


def write_frame_files(frames: DataFrame, folder: str) -> None:
    """Each image as folder/<view>/frame_<number>.jpg, file by file over what is there.

    The folder must be one that all executors share: a mounted one, or a store that tasks can open by path. A file appears under its name only when it is whole, so a
    task that is run again, or twice at a time, leaves whole files. Every image must be a JPEG.
    """
    if not openable(folder):
        raise ValueError(f"tasks can't write to {folder}; write_frame_table can")

    def write(rows: Iterator[Row]) -> None:
        store, home = _store(folder)
        made = set()
        for row in rows:
            image = bytes(row["image"])
            if not image.startswith(b"\xff\xd8"):
                raise ValueError(f"{row['view']}/{row['file_name']} would not be a JPEG image")
            if row["view"] not in made:
                store.create_dir(f"{home}/{row['view']}", recursive=True)
                made.add(row["view"])
            part = f"{home}/{row['view']}/.{row['file_name']}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(image)
            store.move(part, f"{home}/{row['view']}/{row['file_name']}")

    frames.select("view", frame_name(F.col("frame_idx")).alias("file_name"), "image").foreachPartition(write)
