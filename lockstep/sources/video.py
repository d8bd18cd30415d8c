"""Video files as tables: headers, where frames lie, and frames as JPEG images.

A file's index gives a row per frame (`entries`) without reading one. Whatever is asked of view and number is asked of these rows; the frames that are
left are dealt to tasks by their bytes, so that several tasks read one file and none reads a frame that trimming drops. Chunks of
Motion JPEG are images as they stand, uncompressed frames are encoded. MPEG-4 of the simple profile is decoded here, by tasks that each take a run of frames from
one key frame to another. Frames of other codecs need a decoder, given as a function on an open file, for a whole file or for such runs.

Files are opened by the tasks, at their own paths, and read a range at a time. Stores that cannot be opened so come through Spark's binaryFile
reader, whole, one file in a row.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg, mpeg4
from .avi import Frames, excerpt, frames_of, header_of, part, read_header
from .frames import exists, openable, opened

__all__ = ["entries", "external_decoder", "frames", "headers", "images", "jpegs", "read_frames", "read_header"]

HEADERS = "view string, filename string, codec_name string, width string, height string, r_frame_rate string, duration_sec string, nb_frames string"
FRAMES = "view string, n long, image binary"
ENTRIES = "view string, path string, content binary, n long, at long, size long, key boolean, form string"
#: Codecs of frames that stand alone, as images and as uncompressed pictures; and the one that is decoded here.
IMAGES, PICTURES, CODED = "mjpeg", "rawvideo", "mpeg4"
#: How a JPEG image begins and ends.
BEGIN, END = b"\xff\xd8", b"\xff\xd9"
#: Bytes that a decoder's output is read by, bytes of images in a batch, and bytes of frames that a task reads, or decodes.
PIECE, BATCH, SPLIT, SPLIT_CODED = 1 << 16, 8 << 20, 128 << 20, 1 << 20

Decoder = Callable[[BinaryIO], Iterator[bytes]]


def form_of(found: dict[str, str]) -> str:
    """What it takes to make an image of a frame, as text: the codec, and the measures of an uncompressed picture. ValueError for codecs that need a decoder."""
    if found.get("codec_name") not in (IMAGES, PICTURES, CODED):
        raise ValueError(f"frames of codec {found.get('codec_name') or 'unknown'} need a decoder")
    return found["codec_name"] if found["codec_name"] != PICTURES else ":".join(found.get(k, "") for k in ("codec_name", "pixels", "width", "height", "depth", "upside_down"))


def image_of(data: bytes, form: str, at: int = 0) -> bytes:
    """A frame's bytes as a JPEG image; ValueError for a chunk that isn't one, which no viewer would open."""
    if form == IMAGES:
        if not data.startswith(BEGIN):
            raise ValueError(f"the chunk at byte {at} is not a JPEG image")
        return data
    if form == CODED:
        raise ValueError(f"frames of codec {form} are decoded from key frames on, not each alone")
    _, pixels, width, height, depth, upside_down = form.split(":")
    return jpeg.encode(jpeg.picture(data, pixels, int(width), abs(int(height)), int(depth), upside_down == "1"))


def read_frames(file: BinaryIO | bytes) -> Iterator[bytes]:
    """The images of the first video stream in order, for streams that need no decoder. An empty chunk is no frame."""
    file = io.BytesIO(file) if isinstance(file, bytes) else file
    found = header_of(file)
    if found and form_of(found) == CODED:
        yield from mpeg4.images(file)
    elif found:
        form, index = form_of(found), frames_of(file, found)
        for at, size in zip(index.at.tolist(), index.size.tolist()):
            yield image_of(part(file, at, size), form, at)


def jpegs(pipe: BinaryIO) -> Iterator[bytes]:
    """The JPEG images that come out of a pipe one after another, each as it ends.

    Segments are passed over by their sizes, so that a thumbnail inside one neither begins nor ends an image; of what
    follows a start of scan, only a marker that is no restart and no stuffed byte ends it.
    """
    have, ended = bytearray(), False

    def want(n: int) -> bool:
        nonlocal ended
        while len(have) < n and not ended:
            got = pipe.read(PIECE)
            ended = not got
            have.extend(got)
        return len(have) >= n

    while want(2):
        if have[:2] != BEGIN:
            raise ValueError("the decoder's output is not a row of JPEG images")
        at, scan = 2, False
        while True:
            if scan:
                at = have.find(b"\xff", at)
                while at < 0 or not want(at + 2):
                    if ended:
                        raise ValueError("the decoder's output ends inside an image")
                    before = max(len(have) - 1, 2)
                    want(len(have) + 1)
                    at = have.find(b"\xff", before)
            elif not want(at + 2):
                raise ValueError("the decoder's output ends inside an image")
            mark = have[at + 1]
            if mark == 0xD9:
                yield bytes(have[: at + 2])
                del have[: at + 2]
                break
            if scan and (mark == 0 or 0xD0 <= mark <= 0xD7):
                at += 2
            elif mark == 0xFF:
                at += 1
            elif have[at] != 0xFF or not want(at + 4):
                raise ValueError("the decoder's output has a broken image")
            else:
                scan = mark == 0xDA
                at += 2 + int.from_bytes(have[at + 2 : at + 4], "big")


def external_decoder(command: list[str]) -> Decoder:
    """A decoder that pipes a file through a command which writes JPEG images one after another; neither is held whole.

    For instance ffmpeg -i pipe:0 -f image2pipe -c:v mjpeg -vsync 0 pipe:1, where that is installed on the executors.
    """

    def decode(file: BinaryIO) -> Iterator[bytes]:
        import subprocess
        import threading

        def feed() -> None:
            try:
                file.seek(0)
                while piece := file.read(PIECE):
                    run.stdin.write(piece)
                run.stdin.close()
            except BrokenPipeError:  # the command has what it needs, or has failed, which its exit code says
                pass

        run = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        wanted = True
        try:
            yield from jpegs(run.stdout)
        except GeneratorExit:  # the caller wants no more: that the pipe closes is no failure of the command
            wanted = False
            raise
        finally:
            run.stdout.close()
            # a negative code is a signal, such as that of a command killed for its memory
            if (code := run.wait()) and wanted:
                raise subprocess.CalledProcessError(code, command)

    return decode


def _files(spark: SparkSession, views: DataFrame, raw_videos: str) -> DataFrame:
    """(view, filename, path, content) of the registered files, a task for each; content only where a path can't be opened. Fails for one that is missing."""
    rows = [(r["view"], r["source"]) for r in views.select("view", "source").collect()]  # a row per view
    missing = [n for _, n in rows if not exists(spark, f"{raw_videos}/{n}")]
    if missing:
        raise FileNotFoundError(f"no source video: {', '.join(missing)} in {raw_videos}")
    named = spark.createDataFrame([(k, v, n, f"{raw_videos}/{n}") for k, (v, n) in enumerate(rows)], "id long, view string, filename string, path string")
    if openable(raw_videos):
        # a range of as many parts as rows: a hash could deal two files to one task
        each = spark.range(0, len(rows), 1, max(len(rows), 1)).join(F.broadcast(named), "id")
        return each.select("view", "filename", "path", F.lit(None).cast("binary").alias("content"))
    found = spark.read.format("binaryFile").load(sorted({f"{raw_videos}/{n}" for _, n in rows}))
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return found.join(F.broadcast(named), "filename").select("view", "filename", "path", "content")


def _open(path: str, content: bytes | None) -> BinaryIO:
    return opened(path) if content is None else io.BytesIO(content)


def headers(spark: SparkSession, views: DataFrame, raw_videos: str) -> DataFrame:
    """Header fields of each view's file as text; no frame is read. A file that isn't read has empty ones."""

    def fields_of(path: str, content: bytes | None) -> dict[str, str]:
        with _open(path, content) as file:
            return header_of(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in HEADERS.split(", ")]
        for batch in batches:
            fields = [fields_of(p, c) for p, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            rest = [pa.array([f.get(n, "") for f in fields], pa.string()) for n in names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rest], names)

    return _files(spark, views, raw_videos).mapInArrow(run, HEADERS)


def entries(spark: SparkSession, views: DataFrame, raw_videos: str) -> DataFrame:
    """(view, path, content, n, at, size, key, form): a row for each frame of each view's file, from its index; no frame is read.

    Fails for codecs that need a decoder. content is null but where files can't be opened by path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for view, path, content in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                with _open(path, content) as file:
                    if found := header_of(file):
                        form, index = form_of(found), frames_of(file, found)
                        for a in range(0, len(index.at), 1 << 16):
                            yield _entries(view, path, content, a, Frames(*(c[a : a + (1 << 16)] for c in index)), form)

    return _files(spark, views, raw_videos).mapInArrow(run, ENTRIES)


def _entries(view: str, path: str, content: bytes | None, first: int, index: Frames, form: str) -> pa.RecordBatch:
    n = len(index.at)
    same = [pa.repeat(pa.scalar(v, k), n) for v, k in ((view, pa.string()), (path, pa.string()), (content if n == 1 else None, pa.binary()))]
    data = [pa.array(np.arange(first, first + n)), *(pa.array(c) for c in index)]
    return pa.RecordBatch.from_arrays([*same, *data, pa.repeat(pa.scalar(form), n)], [x.split()[0] for x in ENTRIES.split(", ")])


def images(found: DataFrame, split: int = SPLIT) -> DataFrame:
    """(view, n, image) of some of `entries`, whatever filters and joins left of them: each task reads a range of view and n, of about `split` bytes."""
    total = found.agg(F.sum("size")).first()[0] or 0
    dealt = found.repartitionByRange(max(1, -(-total // split)), "view", "n").sortWithinPartitions("view", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened_at = None, None
        try:
            for batch in batches:
                held, size = [], 0
                for row in batch.to_pylist():
                    if row["path"] != opened_at:
                        if file:
                            file.close()
                        file, opened_at = opened(row["path"]), row["path"]
                    held.append((row["view"], row["n"], image_of(part(file, row["at"], row["size"]), row["form"], row["at"])))
                    size += len(held[-1][2])
                    if size >= BATCH:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)
        finally:
            if file:
                file.close()

    return dealt.select("view", "path", "n", "at", "size", "form").mapInArrow(run, FRAMES)


def _rows(held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    view, n, image = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(view), pa.array(n, pa.int64()), pa.array(image, pa.binary())], ["view", "n", "image"])


class _Excerpt(io.RawIOBase):
    """Frames from one key frame up to another, as a file: read in order from its start, or, for who goes back and forth, held whole."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.have, self.whole, self.started = pieces, b"", None, False

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = io.SEEK_SET) -> int:
        if self.whole is None and (at or whence or self.started):
            if self.started:
                raise io.UnsupportedOperation("what was read is gone")
            self.whole = io.BytesIO(b"".join(self.pieces))
        return self.whole.seek(at, whence) if self.whole else 0

    def readinto(self, buffer) -> int:
        if self.whole is not None:
            return self.whole.readinto(buffer)
        self.started = True
        while not self.have and (piece := next(self.pieces, b"")):
            self.have = piece
        got, self.have = self.have[: len(buffer)], self.have[len(buffer) :]
        buffer[: len(got)] = got
        return len(got)


def key_ranges(index: Frames, split: int = SPLIT) -> list[tuple[int, int]]:
    """(first, last) of runs of frames that begin at key frames and have at least `split` bytes, but for the last. What comes before the first key frame is with the first run."""
    n, cuts, before = len(index.at), [0], 0
    total = np.concatenate([[0], np.cumsum(index.size)])
    for k in np.flatnonzero(index.key).tolist():
        if k and total[k] - before >= split:
            cuts.append(k)
            before = total[k]
    return list(zip(cuts, [*cuts[1:], n])) if n else []


def frames(spark: SparkSession, views: DataFrame, raw_videos: str, decode: Decoder = read_frames, split: int | None = None, by_key: bool = False, trimmed: bool = False,
           only: DataFrame | None = None) -> DataFrame:
    """(view, n, image) of each view's file; n counts from the file's first frame. trimmed: frames before the view's offset are not read, or decoded and dropped.

    By default frames that stand alone are read by `entries`, several tasks to a file, and coded ones decoded from key frame to key frame. decode makes a file's
    images from the open file, in order: a task for each file, or, by_key, for each run of about `split` bytes that begins at a key frame. That needs a
    stream whose frames refer to nothing before the last key frame, and fails where a run gives another number of images than it has frames. only: rows (view, n) of
    the frames that are wanted.
    """
    first = F.col("offset") if trimmed else F.lit(0)
    own = F.broadcast(views.select(F.col("view").alias("__view"), first.alias("__first")))  # a row per view
    if decode is read_frames and openable(raw_videos):
        codecs = {r["view"]: r["codec_name"] for r in headers(spark, views, raw_videos).select("view", "codec_name").collect()}  # a row per view
        coded = [v for v, codec in codecs.items() if codec == CODED]
        alone, rest = views.where(~F.col("view").isin([*coded, ""])), views.where(F.col("view").isin([*coded, ""]))
        parts = []
        if len(coded) < len(codecs):
            found = entries(spark, alone, raw_videos).join(own, F.col("view") == F.col("__view")).where(F.col("n") >= F.col("__first"))
            parts.append(images(found if only is None else found.join(only.select("view", "n"), ["view", "n"], "left_semi"), split or SPLIT))
        if coded:
            parts.append(_decoded(spark, rest, own, raw_videos, mpeg4.images, split or SPLIT_CODED, True, only))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _decoded(spark, views, own, raw_videos, decode, split or SPLIT, by_key, only)


RUNS = "view string, path string, content binary, __first int, a long, b long"


def _runs(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _open(row["path"], row["content"]) as file:
                cuts = [(a, b) for a, b in key_ranges(frames_of(file), split) if b > row["__first"]]
            same = [pa.repeat(pa.scalar(row[k], t), len(cuts)) for k, t in (("view", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("__first", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array([c[k] for c in cuts], pa.int64()) for k in (0, 1))], [x.split()[0] for x in RUNS.split(", ")])


def _decoded(spark: SparkSession, views: DataFrame, own: DataFrame, raw_videos: str, decode: Decoder, split: int, by_key: bool, only: DataFrame | None) -> DataFrame:
    files = _files(spark, views, raw_videos).join(own, F.col("view") == F.col("__view")).select("view", "path", "content", "__first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size, k = [], 0, -1
                with _open(row["path"], row["content"]) as file:
                    a, b = row["a"], row["b"]
                    given = _Excerpt(excerpt(file, frames_of(file), int(header_of(file)["stream"]), a, b)) if by_key else file
                    for k, image in enumerate(decode(given)):
                        if a + k < row["__first"]:
                            continue
                        held.append((row["view"], a + k, image))
                        size += len(image)
                        if size >= BATCH:
                            yield _rows(held)
                            held, size = [], 0
                if by_key and k + 1 != b - a:
                    raise ValueError(f"{row['path']}: {k + 1} images of {b - a} frames from {a} on")
                if held:
                    yield _rows(held)

    if by_key:
        cut = files.mapInArrow(lambda batches: _runs(batches, split), RUNS)
        if only is not None:  # runs are few: a row for some hundred frames
            place = cut.select(F.col("view").alias("__of"), "a", "b")
            wanted = only.join(F.broadcast(place), (F.col("view") == F.col("__of")) & (F.col("n") >= F.col("a")) & (F.col("n") < F.col("b"))).select("view", "a", "b").distinct()
            cut = cut.join(wanted, ["view", "a", "b"], "left_semi")
        cut = cut.select("view", "path", "content", "__first", "a", "b")
        dealt = cut.repartitionByRange(max(1, cut.count()), "view", "a")
    else:
        dealt = files.select("*", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    out = dealt.mapInArrow(run, FRAMES)
    return out if only is None else out.join(only.select("view", "n"), ["view", "n"], "left_semi")
