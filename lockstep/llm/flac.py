"""Media columns in FLAC: mono 8-bit streams with blocks of 576 samples, many frames at a time.

Encoding picks, per frame, a constant, a fixed predictor of order 0 to 2 or a linear predictor of order
LPC, whichever needs the fewest bits by estimate, and writes residuals in Rice codes. Decoding finds
frames by the seek table, verifies both checksums of each, reads all frames' residuals step by step in parallel,
undoes the predictors, and yields PCM blocks with their sample offsets. Arithmetic on samples is
exact, so equal payloads give equal streams wherever they are encoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCK, RATE = 576, 8000
LPC, PRECISION = 6, 10
#: Residual partitions of a frame are 2 to this power.
PARTITIONS = 2
FRAMES = 2048
PART_BYTES = 1 << 20
PAD = 255
HEADER = b"\xff\xf8\x24\x02"  # fixed values: sync, fixed blocks; 576 samples at 8 kHz; mono, 8 bits
BLOCKS = "doc_id long, block int, sample_offset long, n_samples int, byte_offset long, pcm binary"


@cache
def _crc_table(width: int, poly: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << width) - 1)
    return out


def crcs(data: np.ndarray, start: np.ndarray, stop: np.ndarray, width: int, poly: int) -> np.ndarray:
    """Checksums of data[start:stop] for many ranges at once, a byte of each at a step."""
    table, out = _crc_table(width, poly), np.zeros(len(start), np.uint32)
    order = np.argsort(start - stop, kind="stable")  # longest first, so that those at work are a prefix
    first, length = start[order], (stop - start)[order]
    state = np.zeros(len(start), np.uint32)
    n = len(start)
    for step in range(int(length[0]) if n else 0):
        while length[n - 1] <= step:
            n -= 1
        at = data[first[:n] + step] ^ (state[:n] >> (width - 8))
        state[:n] = table[at & 255] ^ (state[:n] << 8 & ((1 << width) - 1))
    out[order] = state
    return out


def _number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 63)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(tail)])


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised predictor coefficients, shifts, and residuals of each frame (the first LPC are warm-up)."""
    n = len(x)
    auto = np.stack([(x[:, : BLOCK - k] * x[:, k:]).sum(axis=1, dtype=np.int64) for k in range(LPC + 1)], 1).astype(np.float64)
    error, a = np.maximum(auto[:, 0], 1.0), np.zeros((n, LPC + 1))
    for i in range(1, LPC + 1):
        acc = auto[:, i].copy()
        for j in range(1, i):
            acc -= a[:, j] * auto[:, i - j]
        k = np.clip(acc / error, -0.999, 0.999)
        new = a.copy()
        for j in range(1, i):
            new[:, j] = a[:, j] - k * a[:, i - j]
        new[:, i] = k
        a, error = new, np.maximum(error * (1 - k * k), 1.0)
    a = a[:, 1:]
    _, power = np.frexp(np.maximum(np.abs(a).max(axis=1), 1e-9))
    shift = np.clip(PRECISION - 1 - power, 0, 15).astype(np.int32)
    top = 1 << (PRECISION - 1)
    coef = np.clip(np.rint(a * (1 << shift)[:, None]), -top, top - 1).astype(np.int32)
    guess = np.zeros((n, BLOCK - LPC), np.int32)
    for j in range(LPC):
        guess += coef[:, j : j + 1] * x[:, LPC - 1 - j : BLOCK - 1 - j]
    return coef, shift, x[:, LPC:] - (guess >> shift[:, None])


def encode_frames(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subframe bytes of (n, BLOCK) samples, frame after frame, and their n + 1 bounds."""
    n = len(x)
    x = x.astype(np.int32)
    coef, shift, lpc = _linear(x)
    kinds = [_zigzag(np.diff(x, k, axis=1)) for k in range(3)] + [_zigzag(lpc)]
    orders = np.array([0, 1, 2, LPC])
    mean = np.stack([u.mean(axis=1) for u in kinds], 1)
    cost = BLOCK * np.log2(mean + 1) + orders * 8 + np.array([0, 0, 0, 9 + LPC * PRECISION])
    best = np.argmin(cost, axis=1)
    flat = (x == x[:, :1]).all(axis=1)
    best[flat] = -1
    per, parts = BLOCK >> PARTITIONS, 1 << PARTITIONS
    # every frame as (value, bits) fields: head, warm-up, coefficients, residuals with partition heads before them
    residual = np.full((n, BLOCK), -1, np.int32)
    for k, u in enumerate(kinds):
        rows = np.flatnonzero(best == k)
        residual[rows[:, None], np.arange(orders[k], BLOCK)] = u[rows]
    by = residual.reshape(n, parts, per)
    there = (by >= 0).sum(axis=2)
    mean = np.where(by >= 0, by, 0).sum(axis=2) / np.maximum(there, 1)
    _, power = np.frexp(mean * 0.7 + 0.5)
    rice = np.clip(power, 0, 14)
    rice = np.repeat(rice, per, axis=1).reshape(n, BLOCK)
    quotient = np.where(residual >= 0, residual >> rice, 0)
    code_bits = np.where(residual >= 0, quotient + 1 + rice, 0)
    heads = 8 + 8 * 2 + 9 + PRECISION * LPC + 6  # room for the largest head, laid out below
    head_bits = np.zeros(n, np.int64)
    head = np.zeros((n, heads + 8 * LPC), np.uint8)

    def put(rows: np.ndarray, values: np.ndarray | int, bits: int) -> None:
        values = np.broadcast_to(np.asarray(values, np.int64), (len(rows),))
        for b in range(bits):
            head[rows, head_bits[rows] + b] = values >> (bits - 1 - b) & 1
        head_bits[rows] += bits

    for k in range(-1, 4):
        rows = np.flatnonzero(best == k)
        if not len(rows):
            continue
        put(rows, 0 if k < 0 else (8 + orders[k] if k < 3 else 31 + LPC) << 1, 8)
        for j in range(1 if k < 0 else orders[k]):
            put(rows, x[rows, j] & 255, 8)
        if k == 3:
            put(rows, PRECISION - 1, 4)
            put(rows, shift[rows], 5)
            for j in range(LPC):
                put(rows, coef[rows, j] & ((1 << PRECISION) - 1), PRECISION)
        if k >= 0:
            put(rows, PARTITIONS, 6)
    # where each sample's code starts: partitions begin with four bits of parameter
    lead = np.zeros((n, BLOCK), np.int64)
    lead[:, ::per] = 4
    lead[flat] = 0
    ends = np.cumsum(lead + code_bits, axis=1)
    size = (head_bits + ends[:, -1] + 7) // 8
    bounds = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(bounds[-1]) * 8, np.uint8)
    base = bounds[:-1] * 8
    row = np.repeat(np.arange(n), head_bits)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(head_bits) - head_bits, head_bits)
    bits[base[row] + inside] = head[row, inside]
    start = (base + head_bits)[:, None] + ends - code_bits
    marks = start[:, ::per][~flat]
    param = rice[:, ::per][~flat]
    for b in range(4):
        bits[(marks - 4 + b).ravel()] = (param >> (3 - b) & 1).ravel()
    real = residual >= 0
    at, k, u = (start + quotient)[real], rice[real], residual[real]
    bits[at] = 1
    for b in range(int(k.max()) if len(k) else 0):
        some = k > b
        bits[(at + k)[some] - b] = u[some] >> b & 1
    return np.packbits(bits), bounds


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a payload is a positive multiple of BLOCK bytes, a sample each."""
    count = np.array([len(p) // BLOCK for p in payloads])
    x = (np.frombuffer(b"".join(payloads), np.uint8) ^ 128).view(np.int8).reshape(-1, BLOCK)
    number = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
    heads = [HEADER + _number(k) for k in range(int(count.max()) if len(count) else 0)]
    if heads:
        raw = np.frombuffer(b"".join(heads), np.uint8)
        cuts = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
        heads = [h + bytes([c]) for h, c in zip(heads, crcs(raw, cuts[:-1], cuts[1:], 8, 0x07).tolist())]
    frames = []
    for at in range(0, len(x), FRAMES):
        body, bounds = encode_frames(x[at : at + FRAMES])
        body = body.tobytes()
        part = [heads[k] + body[a:b] for k, a, b in zip(number[at : at + FRAMES], bounds, bounds[1:])]
        cuts = np.concatenate([[0], np.cumsum([len(f) for f in part])])
        check = crcs(np.frombuffer(b"".join(part), np.uint8), cuts[:-1], cuts[1:], 16, 0x8005)
        frames += [f + struct.pack(">H", c) for f, c in zip(part, check.tolist())]
    out, at = [], 0
    for payload, n in zip(payloads, count.tolist()):
        own = frames[at : at + n]
        at += n
        sizes = [len(f) for f in own]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big")
        samples = np.frombuffer(payload, np.uint8) ^ 128
        info += hashlib.md5(samples.tobytes()).digest()
        points, offset = [], 0
        for k, size in enumerate(sizes):
            points.append(struct.pack(">QQH", k * BLOCK, offset, BLOCK))
            offset += size
        table = b"".join(points)
        out.append(b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *own]))
    return out


def seek_points(stream: bytes) -> tuple[np.ndarray, np.ndarray, int, bytes]:
    """(sample offsets, byte offsets in the stream, samples in all, MD5) of a stream with a full seek table."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, table, info, last = 4, b"", b"", False
    while not last:
        kind, size = stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        last = stream[at] >> 7 == 1
        block = stream[at + 4 : at + 4 + size]
        info, table = (block, table) if kind == 0 else (info, block if kind == 3 else table)
        at += 4 + size
    fields = int.from_bytes(info[10:18], "big")
    if fields >> 36 & 31 != 7 or fields >> 41 & 7:
        raise ValueError("only mono streams of 8 bits are read")
    points = np.frombuffer(table, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("size", ">u2")]))
    return points["sample"].astype(np.int64), points["byte"].astype(np.int64) + at, fields & ((1 << 36) - 1), info[18:34]


def decode_frames(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (n, BLOCK) of frames data[start:stop], and their predictors' orders (LPC frames: plus 100). Raises on a wrong checksum."""
    n = len(start)
    if crcs(data, start, stop, 16, 0x8005).any():
        raise ValueError("a frame's CRC-16 is wrong")
    if any((data[start + k] != HEADER[k]).any() for k in range(4)):
        raise ValueError("a frame's header is not of this kind")
    lead = data[start + 4]
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    body = start + 6 + extra
    if crcs(data, start, body, 8, 0x07).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    low = int(start.min())
    part = data[low : int(stop.max())]
    bits = np.unpackbits(part)
    ones = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    following = np.minimum.accumulate(ones[::-1])[::-1]
    padded = np.concatenate([part, np.zeros(4, np.uint8)]).astype(np.uint64)
    word = padded[:-4] << np.uint64(32) | padded[1:-3] << np.uint64(24) | padded[2:-2] << np.uint64(16) | padded[3:-1] << np.uint64(8) | padded[4:]
    pos = (body - low) * 8

    def read(rows: np.ndarray, bits_: np.ndarray | int) -> np.ndarray:
        at = pos[rows]
        value = (word[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64((1 << 40) - 1)
        pos[rows] = at + bits_
        return (value >> np.asarray(40 - bits_, np.uint64)).astype(np.int32)

    everything = np.arange(n)
    kind = read(everything, 8) >> 1
    x = np.zeros((n, BLOCK), np.int32)
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    flat, plain = kind == 0, kind == 1
    signed = lambda v, b: v - ((v >> (b - 1) & 1) << b)
    for j in range(BLOCK if plain.any() else int(max(order.max(), 1))):
        rows = np.flatnonzero((order > j) | plain | (flat & (j == 0)))
        x[rows, j] = signed(read(rows, 8), 8)
    x[flat] = x[flat][:, :1]
    linear = np.flatnonzero(kind >= 32)
    coef, shift = np.zeros((n, 32), np.int32), np.zeros(n, np.int32)
    if len(linear):
        precision = read(linear, 4) + 1
        shift[linear] = signed(read(linear, 5), 5)
        for j in range(int(order[linear].max())):
            rows = order[linear] > j
            coef[linear[rows], j] = signed(read(linear[rows], precision[rows]), precision[rows])
    coded = np.flatnonzero(~flat & ~plain)
    if len(coded):
        head = read(coded, 6)
        per = BLOCK >> (head & 15)
        if (head >> 4).any():
            raise ValueError("only Rice codes with four bits of parameter are read")
        rice, first = np.zeros(len(coded), np.int32), order[coded]
        for s in range(BLOCK):
            begins = s % per == 0
            if begins.any():
                rice[begins] = read(coded[begins], 4)
            rows, k = (coded, rice) if s >= LPC and (first <= s).all() else (coded[first <= s], rice[first <= s])
            at = pos[rows]
            mark = following[at]
            after = mark.astype(np.int64) + 1
            value = (word[np.minimum(after >> 3, len(word) - 1)] << (after & 7).astype(np.uint64)) & np.uint64((1 << 40) - 1)
            u = ((mark - at).astype(np.int32) << k) | (value >> (40 - k).astype(np.uint64)).astype(np.int32)
            pos[rows] = after + k
            x[rows, s] = (u >> 1) ^ -(u & 1)
        for p in range(1, 5):
            rows = np.flatnonzero((kind == 8 + p))
            if len(rows):
                y = x[rows]
                step = [np.diff(y[:, :p], q, axis=1)[:, -1:] for q in range(p)]
                tail = y[:, p:]
                for q in range(p - 1, -1, -1):
                    tail = step[q] + np.cumsum(tail, axis=1)
                x[rows, p:] = tail
        for p in np.unique(order[linear]):
            rows = linear[order[linear] == p]
            y, c, h = x[rows], np.ascontiguousarray(coef[rows, :p][:, ::-1]), shift[rows]
            for s in range(p, BLOCK):
                y[:, s] += (y[:, s - p : s] * c).sum(axis=1, dtype=np.int32) >> h
            x[rows] = y
    return x, order + 100 * (kind >= 32)


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """(payload, byte offsets of its blocks, their predictors) of each stream; checksums and MD5 are verified."""
    points = [seek_points(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    start = np.concatenate([p[1] + b for p, b in zip(points, base)])
    stop = np.concatenate([np.append(p[1][1:] + b, e) for p, b, e in zip(points, base, base[1:])])
    parts = [decode_frames(data, start[k : k + FRAMES], stop[k : k + FRAMES]) for k in range(0, len(start), FRAMES)]
    samples = np.concatenate([p[0].astype(np.int8) for p in parts]).view(np.uint8)
    orders = np.concatenate([p[1] for p in parts])
    out, at = [], 0
    for _, offsets, total, md5 in points:
        own = samples[at : at + len(offsets)].ravel()
        if total != len(own) or hashlib.md5(own.tobytes()).digest() != md5:
            raise ValueError("a stream's MD5 or length is wrong")
        out.append(((own ^ 128).tobytes(), offsets, orders[at : at + len(offsets)]))
        at += len(offsets)
    return out


def padded(text: bytes) -> bytes:
    size = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text + bytes([PAD]) * (size - len(text))


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded to whole blocks with 255, as a FLAC stream.

    Null and empty texts are one block of padding. Repeated rows give a row each; an empty table none; a
    null doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            texts = part.column(1).to_pylist()
            media = encode([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def to_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks (unsigned bytes) of media (doc_id, media) with sample offsets and the seek table's byte offsets; null media give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", PART_BYTES):
            rows = []
            for doc_id, (payload, offsets, _) in zip(part.column(0).to_pylist(), decode(part.column(1).to_pylist())):
                rows += [(doc_id, k, k * BLOCK, BLOCK, int(b), payload[k * BLOCK : (k + 1) * BLOCK]) for k, b in enumerate(offsets)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in BLOCKS.split(", ")])

    return media.where("media IS NOT NULL").select("doc_id", "media").mapInArrow(run, BLOCKS)


def _feature(payload: bytes, orders: np.ndarray) -> str:
    # all but the crossings follows from how often each sample value occurs
    data, value = np.frombuffer(payload, np.uint8), np.arange(-128, 128)
    times, crossings = np.zeros(256, np.int64), 0
    for at in range(0, len(data), PART_BYTES):
        part = data[at : at + PART_BYTES + 1]
        times += np.bincount(part[:PART_BYTES], minlength=256)
        crossings += int(((part[1:] < 128) != (part[:-1] < 128)).sum())
    seen = value[times > 0]
    return f"blocks={len(orders)};min={seen[0]};max={seen[-1]};sum={(times * value).sum()};energy={(times * value * value).sum()};crossings={crossings};linear={(orders >= 100).sum()}"


def features(docs: DataFrame) -> DataFrame:
    """Digests and features of each text's media, from what decoding the stored stream gives."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", PART_BYTES):
            media = part.column(2).to_pylist()
            back = decode(media)
            columns = [
                part.column(0), part.column(1),
                pa.array([len(p) for p, _, _ in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p, _, _ in back]),
                pa.array([zlib.crc32(p[-32:]) for p, _, _ in back], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                pa.array([_feature(p, o) for p, _, o in back]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in out.split(", ")])

    return to_media(docs).mapInArrow(run, out)
