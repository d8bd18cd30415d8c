"""The AVI container: header fields, and where each frame of the first video stream lies.

A walk over a file's chunks ends where a list's size or a null name says so; a file that was given its room beforehand, or is padded, is not
searched to its end. Where a file has an index (idx1, or the indx and ix## chunks of the OpenDML extension), frames are found without
a walk. Nothing here knows Spark; callers read a few ranges of an open file.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from fractions import Fraction
from typing import BinaryIO, NamedTuple

import numpy as np

#: Names of codecs by their four-character codes.
CODECS = {
    "MJPG": "mjpeg", "FMP4": "mpeg4", "XVID": "mpeg4", "DIVX": "mpeg4", "DX50": "mpeg4", "MP4V": "mpeg4", "H264": "h264", "AVC1": "h264",
    "DIB": "rawvideo", "I420": "rawvideo", "IYUV": "rawvideo", "YUY2": "rawvideo",
}
#: Bytes that a walk reads at a time, and that a name and a size take.
BLOCK, HEAD = 1 << 16, 8


class Frames(NamedTuple):
    """Of each frame in order: the first byte of its data, its size, and whether it can be decoded without the frames before it."""

    at: np.ndarray
    size: np.ndarray
    key: np.ndarray


class _Reader:
    """Small reads of an open file, from blocks of it."""

    def __init__(self, file: BinaryIO):
        self.file, self.start, self.block = file, 0, b""
        self.end = file.seek(0, io.SEEK_END)

    def __call__(self, a: int, size: int) -> bytes:
        if not self.start <= a <= a + size <= self.start + len(self.block):
            self.file.seek(a)
            self.start, self.block = a, self.file.read(max(size, BLOCK))
        return self.block[a - self.start : a - self.start + size]


def part(file: BinaryIO, a: int, size: int) -> bytes:
    file.seek(a)
    return file.read(size)


def chunks(file: BinaryIO, start: int = 0, stop: int | None = None, read: _Reader | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, stop) of the chunks of an open RIFF file, lists opened; a chunk cut off by the end is left out.

    A null name ends its list, and whatever is no RIFF list ends the file. A list of size 0 is one whose recording broke off: it goes on to the end
    of what holds it.
    """
    read = read or _Reader(file)
    top = stop is None
    stop = read.end if top else stop
    while start + HEAD <= stop:
        name, size = struct.unpack("<4sI", read(start, HEAD))
        if name == b"\0\0\0\0" or (top and name != b"RIFF"):
            return
        body, end = start + HEAD, start + HEAD + size
        if name in (b"RIFF", b"LIST"):
            end = end if size else stop
            yield from chunks(file, body + 4, min(end, stop), read)
        elif end <= stop:
            yield name, body, end
        start = end + size % 2


def header_of(file: BinaryIO) -> dict[str, str]:
    """Fields of the first video stream of an open file as text; {} if there is none. Frames are not read."""
    fields, kind, stream = {}, None, -1
    read = _Reader(file)
    if read(0, 4) != b"RIFF" or read(8, 4) != b"AVI ":
        return fields
    for name, a, b in chunks(file, read=read):
        if name == b"strh" and b - a >= 36:
            stream += 1
            body = read(a, 36)
            kind = body[:4]
            if kind == b"vids" and not fields:
                scale, rate, _, length = struct.unpack_from("<IIII", body, 20)
                per_second = Fraction(rate, scale) if scale and rate else Fraction(0)
                duration = f"{float(length / per_second):.6f}" if per_second else ""
                fields = {"code": body[4:8].decode("latin-1").upper(), "stream": str(stream), "r_frame_rate": f"{per_second.numerator}/{per_second.denominator}", "duration_sec": duration, "nb_frames": str(length)}
        elif name == b"strf" and kind == b"vids" and "width" not in fields and b - a >= 20:
            _, width, height, _, depth, coded = struct.unpack("<IiiHH4s", read(a, 20))
            coded = "DIB" if coded == b"\0\0\0\0" else coded.decode("latin-1").upper().strip("\0 ")
            codec = CODECS.get(coded, CODECS.get(fields["code"].strip("\0 "), coded.lower()))
            fields |= {"width": str(width), "height": str(abs(height)), "codec_name": codec, "pixels": coded, "depth": str(depth), "upside_down": str(int(height > 0))}
        elif name[2:] in (b"dc", b"db", b"wb") or {"width", "code"} <= set(fields):
            break
    return fields


def extra_of(file: BinaryIO) -> bytes:
    """What the first video stream's format holds past its fixed part: headers that some codecs keep there."""
    kind, read = None, _Reader(file)
    for name, a, b in chunks(file, read=read):
        if name == b"strh":
            kind = read(a, 4)
        elif name == b"strf" and kind == b"vids":
            return read(a + 40, b - a - 40) if b - a > 40 else b""
        elif name[2:] in (b"dc", b"db", b"wb"):
            break
    return b""


def read_header(content: bytes) -> dict[str, str]:
    """header_of a file's first bytes."""
    return header_of(io.BytesIO(content))


def _index1(file: BinaryIO, names: set[bytes], movie: int, a: int, b: int) -> Frames:
    """Frames by an idx1 chunk, whose offsets are from the movi list's name or from the file's start."""
    table = np.frombuffer(part(file, a, (b - a) // 16 * 16), [("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    own = table[np.isin(table["name"], list(names))]
    at = own["at"].astype(np.int64)
    if len(own) and part(file, movie + int(at[0]), 4) == own["name"][0]:
        at += movie
    return Frames(at + HEAD, own["size"].astype(np.int64), (own["flags"] & 0x10) > 0)


def _index2(file: BinaryIO, lists: list[tuple[int, int]]) -> Frames:
    """Frames by the ix## chunks that an indx chunk names."""
    found = [np.zeros((0, 3), np.int64)]
    for at, size in lists:
        body = part(file, at + HEAD, size - HEAD)
        if len(body) < 24:
            continue
        words, _, kind, n = struct.unpack_from("<HBBI", body)
        if kind == 1 and words == 2:
            base = struct.unpack_from("<Q", body, 12)[0]
            table = np.frombuffer(body, "<u4", 2 * min(n, (len(body) - 24) // 8), 24).reshape(-1, 2).astype(np.int64)
            found.append(np.stack([base + table[:, 0], table[:, 1] & 0x7FFFFFFF, table[:, 1] >> 31 == 0], axis=1))
    table = np.concatenate(found)
    return Frames(table[:, 0], table[:, 1], table[:, 2] > 0)


def frames_of(file: BinaryIO, found: dict[str, str] | None = None) -> Frames:
    """Where the frames of the first video stream lie: by an index that covers the file, else by a walk over the chunks.

    An empty chunk, which stands for no change of the picture, is no frame; nor is one that the file's end cuts off. A walk knows key frames
    of MPEG-4, by their first bytes, and of codecs all of whose frames are.
    """
    found = header_of(file) if found is None else found
    if not found:
        return Frames(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    stream = int(found["stream"])
    names = {f"{stream:02d}dc".encode(), f"{stream:02d}db".encode()}
    read = _Reader(file)
    index = _indexed(file, read, stream, names)
    if index is None:
        walked = [(a, b - a) for name, a, b in chunks(file, read=read) if name in names]
        table = np.array(walked, np.int64).reshape(-1, 2)
        alone = found["codec_name"] in ("mjpeg", "rawvideo")
        # MPEG-4: an I picture, or headers before one, at the start of a chunk
        coded = found["codec_name"] == "mpeg4"
        key = [alone or coded and b - a > 4 and ((head := read(a, 5))[:3] == b"\0\0\1" and (head[3] != 0xB6 or head[4] >> 6 == 0)) for a, b in ((a, a + n) for a, n in walked)]
        index = Frames(table[:, 0], table[:, 1], np.array(key, bool))
    keep = (index.size > 0) & (index.at + index.size <= read.end)
    return Frames(*(c[keep] for c in index))


def _indexed(file: BinaryIO, read: _Reader, stream: int, names: set[bytes]) -> Frames | None:
    """The frames by the file's index; None if it has none that covers all of it."""
    start, movie, lists, streams, old = 0, 0, [], -1, None
    while start + 12 <= read.end and read(start, 4) == b"RIFF":
        size = struct.unpack("<I", read(start + 4, 4))[0]
        at, stop = start + 12, min(start + HEAD + size, read.end)
        if start and not lists:
            return None  # an idx1 covers the first RIFF list only
        while not start and at + HEAD <= stop:
            name, n = struct.unpack("<4sI", read(at, HEAD))
            if name == b"LIST" and read(at + 8, 4) == b"hdrl":
                for own, a, b in chunks(file, at + 12, min(at + HEAD + n, stop), read):
                    streams += own == b"strh"
                    if own == b"indx" and streams == stream and b - a >= 24:
                        words, _, kind, count = struct.unpack("<HBBI", read(a, 8))
                        if words == 4 and kind == 0:
                            table = np.frombuffer(read(a + 24, min(16 * count, (b - a - 24) // 16 * 16)), [("at", "<u8"), ("size", "<u4"), ("frames", "<u4")])
                            lists = [(int(x["at"]), int(x["size"])) for x in table if x["at"]]
            elif name == b"LIST" and read(at + 8, 4) == b"movi":
                movie = at + 8
            elif name == b"idx1" and movie and at + HEAD + n <= read.end:
                old = (at + HEAD, at + HEAD + n)
            elif name == b"\0\0\0\0" or not n:
                break
            at += HEAD + n + n % 2
        if not size:
            return None
        start += HEAD + size + size % 2
    return _index2(file, lists) if lists else _index1(file, names, movie, *old) if old else None


def excerpt(file: BinaryIO, frames: Frames, stream: int, first: int, last: int) -> Iterator[bytes]:
    """Pieces of a file of its own with the file's headers and the frames from first up to last, for a decoder that reads a pipe."""
    read, at = _Reader(file), 12
    while read(at + 8, 4) != b"movi" and at + 12 <= read.end:
        at += HEAD + (n := struct.unpack("<I", read(at + 4, 4))[0]) + n % 2
    sizes = frames.size[first:last]
    body = int((sizes + sizes % 2 + HEAD).sum()) + 4
    yield struct.pack("<4sI", b"RIFF", min(at - HEAD + HEAD + body, 0xFFFFFFFF)) + part(file, 8, at - 8) + struct.pack("<4sI4s", b"LIST", min(body, 0xFFFFFFFF), b"movi")
    for a, size in zip(frames.at[first:last].tolist(), sizes.tolist()):
        yield struct.pack("<4sI", f"{stream:02d}dc".encode(), size) + part(file, a, size) + b"\0" * (size % 2)
