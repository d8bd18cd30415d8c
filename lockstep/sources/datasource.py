"""Spark data sources: `avi` and `avi_headers` to read, `frame_files` to write.

    register(spark)
    spark.read.format("avi").load("/videos")                         # view, n, image
    spark.read.format("avi").schema("view string, n long").load(...)  # no frame is read
    frames.write.format("frame_files").mode("overwrite").save("/data")

Reading is dealt by file and by `split` bytes of it. Conditions on view choose files, and such on n choose frames, before a frame is read. Writing stages whole views beside the old ones and swaps them in one
commit, so a job that fails or is killed leaves what was there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from . import mpeg4, video
from .avi import Frames, extra_of, frames_of, header_of, part
from .frames import _names, _store, openable, opened

#: What a finished view's folder holds besides its frames: their number.
MARK = "_COMPLETE"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with the setting that Spark asks for where a source takes conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for source in (Avi, AviHeaders, FrameFiles):
        spark.dataSource.register(source)


def view_of(path: str) -> str:
    """A file's view: its name without what follows the last dot."""
    return path.rpartition("/")[2].rpartition(".")[0]


@dataclass
class Share(InputPartition):
    """The frames of a file that begin in a part of its bytes."""

    path: str
    start: int
    stop: int


class _Files(DataSource):
    """Options: path, a file or a folder of .avi files; split, bytes of a file to a task."""

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        path = self.options["path"].rstrip("/")
        store, home = _store(path)
        info = store.get_file_info(home)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        found = [x for x in store.get_file_info(fs.FileSelector(home)) if x.type == fs.FileType.File and x.extension.lower() == "avi"]
        return sorted((f"{path}/{x.base_name}", x.size) for x in found)


class Avi(_Files):
    """Rows (view, n, image) of AVI files whose frames this library makes images of; a file's view is its name without the extension."""

    @classmethod
    def name(cls) -> str:
        return "avi"

    def schema(self) -> str:
        return video.FRAMES

    def reader(self, schema: StructType) -> AviReader:
        return AviReader(self.files(), schema.names, int(self.options.get("split", video.SPLIT)))


class AviReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], names: list[str], split: int):
        self.files, self.names, self.split, self.first, self.last = files, names, split, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(("view",), str(view)):
                    self.files = [x for x in self.files if view_of(x[0]) == view]
                case In(("view",), views):
                    self.files = [x for x in self.files if view_of(x[0]) in views]
                case EqualTo(("n",), int(n)):
                    self._keep(n, n)
                case GreaterThanOrEqual(("n",), int(n)):
                    self._keep(n, None)
                case GreaterThan(("n",), int(n)):
                    self._keep(n + 1, None)
                case LessThanOrEqual(("n",), int(n)):
                    self._keep(0, n)
                case LessThan(("n",), int(n)):
                    self._keep(0, n - 1)
                case IsNotNull():  # no column ever is
                    pass
                case _:
                    yield f

    def _keep(self, first: int, last: int | None) -> None:
        self.first = max(self.first, first)
        self.last = last if self.last is None else self.last if last is None else min(self.last, last)

    def partitions(self) -> list[Share]:
        return [Share(path, a, a + self.split) for path, size in self.files for a in range(0, max(size, 1), self.split)]

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        if share is None:  # no file is left
            return
        with opened(share.path) as file:
            if not (found := header_of(file)):
                return
            form, index = video.form_of(found), frames_of(file, found)
            last = len(index.at) if self.last is None else self.last
            n = np.flatnonzero((index.at >= share.start) & (index.at < share.stop))
            if form == video.CODED and "image" in self.names:
                yield from self._decoded(file, index, n, last, view_of(share.path))
                return
            n = n[(n >= self.first) & (n <= last)]
            cuts = np.cumsum(index.size[n]) // video.BATCH if "image" in self.names else np.arange(len(n)) >> 16
            for own in np.split(n, np.flatnonzero(np.diff(cuts)) + 1):
                columns = {"view": pa.repeat(pa.scalar(view_of(share.path)), len(own)), "n": pa.array(own, pa.int64())}
                if "image" in self.names:
                    columns["image"] = pa.array([video.image_of(part(file, int(index.at[k]), int(index.size[k])), form, int(index.at[k])) for k in own], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[k] for k in self.names], self.names)


    def _decoded(self, file: BinaryIO, index: Frames, n: np.ndarray, last: int, view: str) -> Iterator[pa.RecordBatch]:
        """The wanted frames of the runs that begin, at a key frame, among the frames n; each is decoded as far as it is wanted."""
        for a, b in video.key_ranges(index, 0):
            if not len(n) or not n[0] <= a <= n[-1] or b <= self.first or a > last:
                continue
            decoder = mpeg4.Decoder(extra_of(file))
            for k in range(a, min(b, last + 1)):
                if decoder.pictures(part(file, int(index.at[k]), int(index.size[k]))) != 1:
                    raise ValueError(f"frame {k} of {view} is not one picture")
                if k >= self.first:
                    columns = {"view": [view], "n": pa.array([k], pa.int64()), "image": [decoder.image()]}
                    yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in self.names], self.names)


class AviHeaders(_Files):
    """A row of header fields, as text, for each AVI file; no frame is read."""

    @classmethod
    def name(cls) -> str:
        return "avi_headers"

    def schema(self) -> str:
        return video.HEADERS

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.files(), schema.names, 0)


class HeaderReader(AviReader):
    def partitions(self) -> list[Share]:
        return [Share(path, 0, size) for path, size in self.files]

    def read(self, share: Share | None) -> Iterator[tuple]:
        if share is None:
            return
        with opened(share.path) as file:
            row = {"view": view_of(share.path), "filename": share.path.rpartition("/")[2]} | header_of(file)
        yield tuple(row.get(k, "") for k in self.names)


class FrameFiles(DataSource):
    """Rows (view, frame_idx, image) as path/<view>/frame_<number>.jpg, in a folder that all executors share.

    overwrite: each view that is written, or named in the option `views`, has just the new frames afterwards; other files of its folder
    stay. The new ones are staged beside it, then swapped in. append: frames are added, each as it is whole. Either way a view's folder tells, in MARK, how many frames it has
    by the last commit, and what `views`, a JSON object by view, notes of it.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "view string, frame_idx long, image binary"

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        path = self.options["path"].rstrip("/")
        if not openable(path):
            raise ValueError(f"tasks can't write to {path}; write_frame_table can")
        return FrameWriter(path, overwrite, json.loads(self.options.get("views", "{}")))


@dataclass
class Written(WriterCommitMessage):
    views: list[str]


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, views: dict):
        self.path, self.overwrite, self.views = path, overwrite, views
        self.staged = f".new-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Frames of a task, each under its name only when it is whole: a task that is run again leaves the same files."""
        store, home = _store(self.path)
        top = f"{home}/{self.staged}" if self.overwrite else home
        seen: set[str] = set()
        for batch in iterator:
            for view, k, image in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("view", "frame_idx", "image"))):
                view, k, image = view.as_py(), k.as_py(), image.as_py()
                if not image or not image.startswith(video.BEGIN):
                    raise ValueError(f"frame {k} of {view} would not be a JPEG image")
                if view not in seen:
                    store.create_dir(f"{top}/{view}", recursive=True)
                    seen.add(view)
                name = f"frame_{k:04d}.jpg"
                whole = f"{top}/{view}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(whole) as out:
                    out.write(image)
                store.move(whole, f"{top}/{view}/{name}")
        return Written(sorted(seen))

    def commit(self, messages: list[Written | None]) -> None:
        store, home = _store(self.path)
        frame = lambda name: name.startswith("frame_") and name.endswith(".jpg")
        names = lambda folder: (x.rpartition("/")[2] for some in _names(folder) for x, _ in some)
        for view in dict.fromkeys([*self.views, *(v for m in messages if m for v in m.views)]):
            new, now = f"{home}/{self.staged}/{view}", f"{home}/{view}"
            store.create_dir(now, recursive=True)
            if self.overwrite:
                store.create_dir(new, recursive=True)
                old = f"{home}/.old-{uuid.uuid4().hex}"
                store.move(now, old)
                store.move(new, now)
                for name in names(old):
                    if not frame(name) and name != MARK:
                        store.move(f"{old}/{name}", f"{now}/{name}")
                store.delete_dir(old)
            with store.open_output_stream(f"{now}/{MARK}") as out:
                out.write(json.dumps({"frames": sum(map(frame, names(now))), "note": self.views.get(view)}).encode())
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, home = _store(self.path)
        staged = f"{home}/{self.staged}"
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


def promised(folder: str) -> dict | None:
    """What the mark of a view's folder says: frames, how many it had when it was last committed, and note. None if it never was."""
    try:
        with opened(f"{folder}/{MARK}") as file:
            return json.loads(file.read())
    except (FileNotFoundError, ValueError):
        return None
