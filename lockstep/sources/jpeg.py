"""Pictures as baseline JPEG images, and the uncompressed frames that they are made of.

A picture is encoded as a whole by array operations: colour, blocks, cosine transform, quantisation by a rule, and
Huffman codes fitted to its own symbols. Colour is not subsampled.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Steps of quantisation grow with the frequency, from 1 by COARSE a step.
COARSE = 0.75
#: Order in which a block's 64 numbers are written: along diagonals, turning at each edge.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
STEPS = np.array([round(1 + COARSE * (k // 8 + k % 8)) for k in range(64)])
#: Rows are frequencies: the orthonormal cosine transform of 8 numbers.
COSINES = np.array([[(0.125 if u == 0 else 0.25) ** 0.5 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Symbols of a block's end and of 16 zeros in a row.
END, ZEROS = 0x00, 0xF0


def from_rgb(rgb: np.ndarray) -> np.ndarray:
    """(height, width, 3) of luma and two colour differences, full range, of red, green and blue."""
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402], axis=-1)


def picture(data: bytes, pixels: str, width: int, height: int, depth: int = 24, upside_down: bool = False) -> np.ndarray:
    """An uncompressed frame as luma and colour differences; ValueError for a size or kind that isn't known."""
    raw = np.frombuffer(data, np.uint8)
    half = (height // 2, width // 2)
    if pixels in ("DIB", "") and depth in (24, 32):
        row = (width * depth // 8 + 3) // 4 * 4
        if len(raw) >= row * height:
            rows = raw[: row * height].reshape(height, row)[:, : width * depth // 8].reshape(height, width, depth // 8)
            return from_rgb((rows[::-1] if upside_down else rows)[..., 2::-1])
    elif pixels in ("I420", "IYUV") and width % 2 == height % 2 == 0 and len(raw) >= width * height * 3 // 2:
        n = width * height
        planes = [raw[:n].reshape(height, width), *(raw[n + k * n // 4 : n + (k + 1) * n // 4].reshape(half).repeat(2, 0).repeat(2, 1) for k in range(2))]
        return full_range(np.stack(planes, axis=-1))
    elif pixels == "YUY2" and width % 2 == 0 and len(raw) >= width * height * 2:
        four = raw[: width * height * 2].reshape(height, width // 2, 4)
        planes = [four[..., ::2].reshape(height, width), four[..., 1].repeat(2, 1), four[..., 3].repeat(2, 1)]
        return full_range(np.stack(planes, axis=-1))
    raise ValueError(f"no frame of {width}x{height} {pixels or 'DIB'} pixels of {depth} bits in {len(data)} bytes")


def full_range(video: np.ndarray) -> np.ndarray:
    """Video range (16 to 235, and 240 for colour) as full range."""
    return (video - np.array([16, 128, 128])) * np.array([255 / 219, 255 / 224, 255 / 224]) + np.array([0, 128, 128])


def lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of Huffman codes, of 16 bits at most, that leave the code of ones unused."""
    heap = [(n, s, (s,)) for s, n in counts.items()] + [(0, 256, (256,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, 256], 0)
    while len(heap) > 1:
        (n, s, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for x in a + b:
            depth[x] += 1
        heapq.heappush(heap, (n + m, s, a + b))
    depth[256] = max(depth.values())  # the rarest, so a longest code is its own already
    if depth[256] > 16:  # rarer symbols count for more until all fit
        return lengths({s: n // 2 + 1 for s, n in counts.items()})
    return {s: d for s, d in depth.items() if s != 256}


def codes(size: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length by symbol, and the table as an image holds it; shorter codes come first, then symbols in order."""
    code, bits, at, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    order = sorted(size, key=lambda s: (size[s], s))
    for s in order:
        at <<= size[s] - last
        code[s], bits[s], last = at, size[s], size[s]
        at += 1
    per = [sum(d == k for d in size.values()) for k in range(1, 17)]
    return code, bits, bytes(per) + bytes(order)


def _size(values: np.ndarray) -> np.ndarray:
    """Bits that numbers take without their sign."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def quantised(planes: np.ndarray) -> np.ndarray:
    """(blocks across, by row and component, 64) of a picture: whole numbers in the order they are written."""
    height, width, n = planes.shape
    whole = np.pad(planes, ((0, -height % 8), (0, -width % 8), (0, 0)), "edge") - 128
    blocks = whole.reshape(len(whole) // 8, 8, -1, 8, n).transpose(0, 2, 4, 1, 3).reshape(-1, 8, 8)
    return np.rint((COSINES @ blocks @ COSINES.T).reshape(-1, 64) / STEPS).astype(np.int64)[:, ZIGZAG]


def encode(planes: np.ndarray) -> bytes:
    """A baseline JPEG image of (height, width, 1 or 3) luma and colour differences."""
    height, width, n = planes.shape
    blocks = quantised(planes)
    steady = blocks[:, 0].reshape(-1, n)
    steps = np.diff(steady, axis=0, prepend=0).reshape(-1)
    row, at = np.nonzero(blocks[:, 1:])
    value = blocks[row, at + 1]
    run = at - np.where(np.diff(row, prepend=-1) > 0, -1, np.concatenate([[0], at[:-1]])) - 1
    last = np.full(len(blocks), -1)
    last[row] = at
    # (place, is the steady part, symbol, bits that follow it, how many)
    low = lambda v: np.where(v < 0, v + (1 << _size(v)) - 1, v)
    zeros, short = np.repeat(np.arange(len(row)), run // 16), np.flatnonzero(last < 62)
    none = lambda k: np.zeros(len(k), np.int64)
    place = np.concatenate([np.arange(len(blocks)) * 256, row[zeros] * 256 + 2 * at[zeros] + 1, row * 256 + 2 * at + 2, short * 256 + 255])
    symbol = np.concatenate([_size(steps), none(zeros) + ZEROS, (run % 16) * 16 + _size(value), none(short) + END])
    rest = np.concatenate([low(steps), none(zeros), low(value), none(short)])
    follow = np.concatenate([_size(steps), none(zeros), _size(value), none(short)])
    first = place % 256 == 0
    out, size, tables = none(place), none(place), b""
    for kind, own in ((0, first), (1, ~first)):
        found, counts = np.unique(symbol[own], return_counts=True)
        code, bits, table = codes(lengths(dict(zip(found.tolist(), counts.tolist())) or {END: 1}))
        out[own], size[own] = code[symbol[own]] << follow[own] | rest[own], bits[symbol[own]] + follow[own]
        tables += b"\xff\xc4" + struct.pack(">HB", 3 + len(table), kind << 4) + table
    order = np.argsort(place, kind="stable")
    out, size = out[order], size[order]
    ends = np.cumsum(size)
    bit = np.arange(ends[-1]) - np.repeat(ends - size, size)
    packed = np.packbits(np.concatenate([np.repeat(out, size) >> (np.repeat(size, size) - 1 - bit) & 1, np.ones(-ends[-1] % 8, np.int64)]).astype(np.uint8))
    steps_ = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(STEPS[ZIGZAG].tolist())
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, height, width, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n))
    scan = b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0"
    app = b"\xff\xe0" + struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 0x101, 0, 1, 1, 0, 0)
    return b"\xff\xd8" + app + steps_ + frame + tables + scan + packed.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"
