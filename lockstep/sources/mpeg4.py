"""Pictures of MPEG-4 part 2 video, simple profile: I and P pictures, one or four vectors to a macroblock, half samples.

A picture is read symbol by symbol into vectors and coefficients; prediction, inverse transform and what they make together are array
operations over the whole picture. What lies outside the profile is refused by name: B pictures, sprites, interlacing, quarter samples,
quantisation by matrices, data partitions, video packets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

from . import jpeg
from .avi import extra_of, frames_of, part

# The codes of the standard's tables, in the order of what they stand for.
#: Macroblock kinds with the chroma pattern 0 to 3 of each; the last code is stuffing.
INTRA_KINDS = "1 001 010 011 0001 000001 000010 000011 000000001"
INTER_KINDS = "1 0011 0010 000101 011 0000111 0000110 000000101 010 0000101 0000100 00000101 00011 00000100 00000011 0000011 000100 000000100 000000011 000000010 000000001"
#: Luma patterns 0 to 15 of intra macroblocks; those of others are 15 less the number.
PATTERNS = "0011 00101 00100 1001 00011 0111 000010 1011 00010 000011 0101 1010 0100 1000 0110 11"
#: Sizes of vectors' differences, 0 to 32.
VECTORS = (
    "1 01 001 0001 000011 0000101 0000100 0000011 000001011 000001010 000001001 0000010001 0000010000 0000001111 0000001110 0000001101 0000001100 0000001011 0000001010 "
    "0000001001 0000001000 0000000111 0000000110 0000000101 0000000100 00000000111 00000000110 00000000101 00000000100 00000000011 00000000010 000000000011 000000000010"
)
#: Bits of the steady part's difference, 0 to 12, for luma and chroma.
LUMA_SIZES = "011 11 10 010 001 0001 00001 000001 0000001 00000001 000000001 0000000001 00000000001"
CHROMA_SIZES = "11 10 01 001 0001 00001 000001 0000001 00000001 000000001 0000000001 00000000001 000000000001"
#: Coefficients: runs in order, and levels from 1 for each; first those that others follow, then the last of a block, then the escape.
INTRA_EVENTS = (
    "10 110 1111 01101 01100 010101 010011 010010 0010111 00011111 00011110 00011101 000100101 000100100 000100011 000100001 0000100001 0000100000 0000001111 0000001110 "
    "00000000111 00000000110 00000100000 00000100001 000001010000 000001010001 000001010010 1110 010100 0010110 00011100 000100000 000011111 0000001101 00000100010 000001010011 000001010101 "
    "01011 0010101 000011110 0000001100 000001010110 010001 00011011 000011101 0000001011 010000 000100010 0000001010 001101 000011100 0000001000 0010010 000011011 000001010100 "
    "0010100 000011010 000001010111 00011001 0000001001 00011000 00000100011 00010111 000011001 000011000 0000000111 000001011000 "
    "0111 001100 00010110 000010111 0000000110 00000000101 00000000100 000001011001 001111 000010110 0000000101 001110 0000000100 0010001 00000100100 0010000 00000100101 "
    "0010011 000001011010 00010101 000001011011 00010100 00010011 00011010 000010101 000010100 000010011 000010010 000010001 00000100110 00000100111 000001011100 000001011101 000001011110 000001011111 0000011"
)
INTER_EVENTS = (
    "10 1111 010101 0010111 00011111 000100101 000100100 0000100001 0000100000 00000000111 00000000110 00000100000 110 010100 00011110 0000001111 00000100001 000001010000 "
    "1110 00011101 0000001110 000001010001 01101 000100011 0000001101 01100 000100010 000001010010 01011 0000001100 000001010011 010011 0000001011 000001010100 010010 0000001010 "
    "010001 0000001001 010000 0000001000 0010110 000001010101 0010101 0010100 00011100 00011011 000100001 000100000 000011111 000011110 000011101 000011100 000011011 000011010 "
    "00000100010 00000100011 000001010110 000001010111 0111 000011001 00000000101 001111 00000000100 001110 001101 001100 0010011 0010010 0010001 0010000 00011010 00011001 00011000 00010111 "
    "00010110 00010101 00010100 00010011 000011000 000010111 000010110 000010101 000010100 000010011 000010010 000010001 0000000111 0000000110 0000000101 0000000100 "
    "00000100100 00000100101 00000100110 00000100111 000001011000 000001011001 000001011010 000001011011 000001011100 000001011101 000001011110 000001011111 0000011"
)
#: Levels that each run has, of those that others follow and of the last ones.
INTRA_LEVELS = ([27, 10, 5, 4, 3, 3, 3, 3, 2, 2, *[1] * 5], [8, 3, 2, 2, 2, 2, 2, *[1] * 14])
INTER_LEVELS = ([12, 6, 4, 3, 3, 3, 3, 2, 2, 2, 2, *[1] * 16], [3, 2, *[1] * 39])
#: Orders in which a block's coefficients come where they are predicted from above, or from the left.
FROM_ABOVE = [
    0, 1, 2, 3, 8, 9, 16, 17, 10, 11, 4, 5, 6, 7, 15, 14, 13, 12, 19, 18, 24, 25, 32, 33, 26, 27, 20, 21, 22, 23, 28, 29,
    30, 31, 34, 35, 40, 41, 48, 49, 42, 43, 36, 37, 38, 39, 44, 45, 46, 47, 50, 51, 56, 57, 58, 59, 52, 53, 54, 55, 60, 61, 62, 63,
]
FROM_LEFT = [
    0, 8, 16, 24, 1, 9, 2, 10, 17, 25, 32, 40, 48, 56, 57, 49, 41, 33, 26, 18, 3, 11, 4, 12, 19, 27, 34, 42, 50, 58, 35, 43,
    51, 59, 20, 28, 5, 13, 6, 14, 21, 29, 36, 44, 52, 60, 37, 45, 53, 61, 22, 30, 7, 15, 23, 31, 38, 46, 54, 62, 39, 47, 55, 63,
]
#: Quantisers below which the steady part has codes of its own, by their number in the picture's header.
STEADY_BELOW = (99, 13, 15, 17, 19, 21, 23, 0)
QUANTISER_STEPS = (-1, -2, 1, 2)

ZIGZAG = jpeg.ZIGZAG.tolist()
INTER, INTER_Q, INTER_4, INTRA, INTRA_Q, STUFFING = range(6)
ESCAPE = (0, 0, 0)
#: The steady part where there is no neighbour: middle grey.
GREY = 1024


def table(codes: str, values: list, width: int) -> list:
    """By the next `width` bits: (value, bits of its code), or None."""
    out: list = [None] * (1 << width)
    for code, value in zip(codes.split(), values, strict=True):
        rest = width - len(code)
        for k in range(1 << rest):
            out[int(code, 2) << rest | k] = (value, len(code))
    return out


def events(levels: tuple[list[int], list[int]]) -> list[tuple[int, int, int]]:
    """(last, run, level) in the order of the tables; the escape at the end."""
    return [(last, run, level) for last in (0, 1) for run, n in enumerate(levels[last]) for level in range(1, n + 1)] + [ESCAPE]


_INTRA_KIND = table(INTRA_KINDS, [(k, c) for k in (INTRA, INTRA_Q) for c in range(4)] + [(STUFFING, 0)], 9)
_INTER_KIND = table(INTER_KINDS, [(k, c) for k in (INTER, INTER_Q, INTER_4, INTRA, INTRA_Q) for c in range(4)] + [(STUFFING, 0)], 9)
_PATTERN = table(PATTERNS, list(range(16)), 6)
_VECTOR = table(VECTORS, list(range(33)), 12)
_SIZES = table(LUMA_SIZES, list(range(13)), 12), table(CHROMA_SIZES, list(range(13)), 12)
_EVENTS = {True: (table(INTRA_EVENTS, events(INTRA_LEVELS), 12), INTRA_LEVELS), False: (table(INTER_EVENTS, events(INTER_LEVELS), 12), INTER_LEVELS)}


class Bits:
    """The bits of some bytes, from a place on; zeros past their end."""

    def __init__(self, data: bytes, at: int = 0):
        padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
        n = len(data) + 3
        self.windows = (padded[:n] << 32 | padded[1 : n + 1] << 24 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 8 | padded[4 : n + 4]).tolist()
        self.at, self.end = at, 8 * len(data)

    def peek(self, n: int) -> int:
        if self.at > self.end:
            raise ValueError("a picture ends before its last macroblock")
        return self.windows[self.at >> 3] >> 40 - (self.at & 7) - n & (1 << n) - 1

    def __call__(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value

    def code(self, by_bits: list, width: int):
        found = by_bits[self.peek(width)]
        if found is None:
            raise ValueError(f"no code at bit {self.at}")
        self.at += found[1]
        return found[0]


class Layer(NamedTuple):
    """What a picture needs of its layer's header."""

    width: int
    height: int
    time_bits: int
    packets: bool


def layer(bits: Bits, version: int = 1) -> Layer:
    bits(1 + 8)
    if bits(1):
        version = bits(4)
        bits(3)
    if bits(4) == 15:
        bits(16)
    if bits(1):
        bits(3)
        if bits(1):
            for n in (16, 16, 16, 15, 16):
                bits(n)
    shape = bits(2)
    bits(1)
    resolution = bits(16)
    bits(1)
    time_bits = max(1, (resolution - 1).bit_length())
    if bits(1):
        bits(time_bits)
    bits(1)
    width = bits(13)
    bits(1)
    height = bits(13)
    bits(1)
    interlaced, _ = bits(1), bits(1)
    sprite = bits(1 if version == 1 else 2)
    deep, matrices = bits(1), bits(1)
    quarter = bits(1) if version != 1 else 0
    estimated = not bits(1)
    packets = not bits(1)
    parted = bits(1)
    for name, found in (("shapes", shape), ("interlacing", interlaced), ("sprites", sprite), ("other than 8 bits", deep), ("quantisation by matrices", matrices), ("quarter samples", quarter), ("complexity estimation", estimated), ("data partitions", parted)):
        if found:
            raise ValueError(f"MPEG-4 video with {name} is not decoded here")
    return Layer(width, height, time_bits, packets)


def steady_scale(quantiser: int, luma: bool) -> int:
    if quantiser < 5:
        return 8
    if luma:
        return 2 * quantiser if quantiser < 9 else quantiser + 8 if quantiser < 25 else 2 * quantiser - 16
    return (quantiser + 13) // 2 if quantiser < 25 else quantiser - 6


def _toward(a: int, b: int) -> int:
    """a / b to the nearest whole number, halves away from 0."""
    return (abs(a) + b // 2) // b * (1 if a >= 0 else -1)


def _middle(a: int, b: int, c: int) -> int:
    return a + b + c - min(a, b, c) - max(a, b, c)


class _Picture:
    """Vectors and coefficients of a picture as they are read."""

    def __init__(self, bits: Bits, size: Layer, quantiser: int, steady_below: int, reach: int, predicted: bool):
        self.bits, self.quantiser, self.steady_below, self.reach, self.predicted = bits, quantiser, steady_below, reach, predicted
        self.across, self.down = -(-size.width // 16), -(-size.height // 16)
        self.packets = size.packets
        #: Vectors of 8x8 blocks, in half samples.
        self.vectors = [[(0, 0)] * (2 * self.across) for _ in range(2 * self.down)]
        self.intra = np.zeros((self.down, self.across), bool)
        #: Blocks of intra macroblocks by component and place: steady part, first column, first row, quantiser.
        self.neighbours: dict[tuple[int, int, int], tuple[int, list[int], list[int], int]] = {}
        self.places: list[int] = []
        self.values: list[int] = []

    def read(self) -> None:
        for y in range(self.down):
            for x in range(self.across):
                self._macroblock(y, x)

    def _macroblock(self, y: int, x: int) -> None:
        bits = self.bits
        if self.packets and bits.peek(1) == 0 and (x or y):
            gap = 8 - (bits.at & 7)
            if bits.peek(gap) == (1 << gap - 1) - 1 and bits.windows[(bits.at + gap) >> 3] >> 24 == 0:
                raise ValueError("MPEG-4 video in packets is not decoded here")
        kind = STUFFING
        while kind == STUFFING:
            if self.predicted and bits(1):
                return
            kind, chroma = bits.code(_INTER_KIND if self.predicted else _INTRA_KIND, 9)
        intra = kind in (INTRA, INTRA_Q)
        from_near = intra and bits(1)
        luma = bits.code(_PATTERN, 6)
        pattern = (luma if intra else 15 - luma) << 2 | chroma
        own_codes = self.quantiser < self.steady_below
        if kind in (INTER_Q, INTRA_Q):
            self.quantiser = min(31, max(1, self.quantiser + QUANTISER_STEPS[bits(2)]))
        if not intra:
            self._vectors(y, x, 4 if kind == INTER_4 else 1)
        self.intra[y, x] = intra
        for k in range(6):
            coded = pattern >> 5 - k & 1
            place = (0, 2 * y + k // 2, 2 * x + k % 2) if k < 4 else (k - 3, y, x)
            block = self._intra(place, coded, own_codes, from_near) if intra else self._inter() if coded else None
            if block:
                first = ((y * self.across + x) * 6 + k) * 64
                for at, value in enumerate(block):
                    if value:
                        self.places.append(first + at)
                        self.values.append(value)

    def _vectors(self, y: int, x: int, n: int) -> None:
        for k in range(n):
            row, column = 2 * y + k // 2, 2 * x + k % 2
            third = ((row - 1, column + 2), (row - 1, column + 1), (row - 1, column + 1), (row - 1, column - 1))[k]
            near = [self.vectors[a][b] if a >= 0 and 0 <= b < 2 * self.across else None for a, b in ((row, column - 1), (row - 1, column), third)]
            valid = [v for v in near if v]
            near = [v or (valid[0] if len(valid) == 1 else (0, 0)) for v in near]
            vector = tuple(self._vector(_middle(*(v[c] for v in near))) for c in (0, 1))
            for a, b in [(row, column)] if n == 4 else [(row + i, column + j) for i in (0, 1) for j in (0, 1)]:
                self.vectors[a][b] = vector

    def _vector(self, near: int) -> int:
        bits = self.bits
        size = bits.code(_VECTOR, 12)
        if size:
            minus = bits(1)
            if self.reach > 1:
                size = (size - 1 << self.reach - 1) + bits(self.reach - 1) + 1
            size = -size if minus else size
        half = 32 << self.reach - 1
        return (near + size + half) % (2 * half) - half

    def _coefficients(self, block: list[int], at: int, order: list[int], intra: bool) -> None:
        """Fill a block from its place `at` in the order on."""
        bits = self.bits
        codes, levels = _EVENTS[intra]
        while True:
            last, run, level = bits.code(codes, 12)
            if not level:
                if not bits(1):
                    last, run, level = bits.code(codes, 12)
                    level += levels[last][run]
                elif not bits(1):
                    last, run, level = bits.code(codes, 12)
                    run += sum(n >= level for n in levels[last])  # levels fall with the run, so this is the longest run with this level, and one
                else:
                    last, run, _, level, _ = bits(1), bits(6), bits(1), bits(12), bits(1)
                    signed = level - 4096 if level & 2048 else level
                    level = 0
            if level:
                signed = -level if bits(1) else level
            at += run
            if at > 63:
                raise ValueError(f"a block has more than 64 coefficients at bit {bits.at}")
            block[order[at]] = signed
            at += 1
            if last:
                return

    def _scaled(self, level: int) -> int:
        size = self.quantiser * (2 * abs(level) + 1) - (self.quantiser % 2 == 0)
        return max(-2048, min(2047, size if level > 0 else -size))

    def _inter(self) -> list[int]:
        block = [0] * 64
        self._coefficients(block, 0, ZIGZAG, False)
        return [self._scaled(v) if v else 0 for v in block]

    def _intra(self, place: tuple[int, int, int], coded: int, own_codes: bool, from_near: int) -> list[int]:
        bits, (component, y, x) = self.bits, place
        left, corner, above = (self.neighbours.get((component, a, b)) for a, b in ((y, x - 1), (y - 1, x - 1), (y - 1, x)))
        a, b, c = (n[0] if n else GREY for n in (left, corner, above))
        from_above = abs(a - b) < abs(b - c)
        near, steady = (above, c) if from_above else (left, a)
        block = [0] * 64
        if own_codes:
            size = bits.code(_SIZES[component > 0], 12)
            if size:
                value = bits(size)
                block[0] = value if value >> size - 1 else value - (1 << size) + 1
                if size > 8:
                    bits(1)
        if coded:
            self._coefficients(block, int(own_codes), (FROM_ABOVE if from_above else FROM_LEFT) if from_near else ZIGZAG, True)
        scale = steady_scale(self.quantiser, component == 0)
        block[0] += (steady + scale // 2) // scale
        if from_near and near:
            step, values = (1, near[2]) if from_above else (8, near[1])
            for k in range(1, 8):
                block[k * step] += _toward(values[k] * near[3], self.quantiser)
        whole = max(0, min(2047, block[0] * scale))
        self.neighbours[place] = (whole, block[::8], block[:8], self.quantiser)
        return [whole, *(self._scaled(v) if v else 0 for v in block[1:])]


def moved(reference: np.ndarray, vectors: np.ndarray, rounding: int) -> np.ndarray:
    """(rows, columns, 8, 8) of a plane's blocks as their vectors, in half samples, find them in the reference; its edges go on."""
    rows, columns = vectors.shape[:2]
    along = np.arange(9)
    y = np.clip(8 * np.arange(rows)[:, None, None] + (vectors[..., 1] >> 1)[..., None] + along, 0, len(reference) - 1)
    x = np.clip(8 * np.arange(columns)[None, :, None] + (vectors[..., 0] >> 1)[..., None] + along, 0, reference.shape[1] - 1)
    near = reference[y[..., :, None], x[..., None, :]].astype(np.int32)
    half_x, half_y = ((vectors[..., c] & 1).astype(bool)[..., None, None] for c in (0, 1))
    a, b, c, d = near[..., :8, :8], near[..., :8, 1:], near[..., 1:, :8], near[..., 1:, 1:]
    one = np.where(half_x, a + b, a + c) + 1 - rounding >> 1
    return np.where(half_x & half_y, a + b + c + d + 2 - rounding >> 2, np.where(half_x | half_y, one, a))


def _plane(blocks: np.ndarray) -> np.ndarray:
    rows, columns = blocks.shape[:2]
    return blocks.transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)


def chroma_vectors(luma: np.ndarray) -> np.ndarray:
    """Vectors of chroma blocks by the sums of the four luma vectors over them, in sixteenths to the nearest half, but for what is near a whole one."""
    total = luma[::2, ::2] + luma[1::2, ::2] + luma[::2, 1::2] + luma[1::2, 1::2]
    part_ = total & 15
    return (total >> 4) * 2 + (part_ > 2) + (part_ > 13)


def _made(read: _Picture, reference: list[np.ndarray] | None, rounding: int) -> list[np.ndarray]:
    coefficients = np.zeros(read.down * read.across * 6 * 64)
    coefficients[read.places] = read.values
    blocks = np.rint(jpeg.COSINES.T @ coefficients.reshape(-1, 8, 8) @ jpeg.COSINES).astype(np.int32).reshape(read.down, read.across, 6, 8, 8)
    luma = blocks[:, :, :4].reshape(read.down, read.across, 2, 2, 8, 8).transpose(0, 2, 1, 3, 4, 5).reshape(2 * read.down, 2 * read.across, 8, 8)
    parts = [luma, blocks[:, :, 4], blocks[:, :, 5]]
    if reference is not None:
        vectors = np.array(read.vectors)
        near = chroma_vectors(vectors)
        for k, (own, plane) in enumerate(zip((vectors, near, near), reference)):
            inter = ~(read.intra.repeat(2, 0).repeat(2, 1) if k == 0 else read.intra)
            parts[k] = parts[k] + moved(plane, own, rounding) * inter[..., None, None]
    return [np.clip(_plane(p), 0, 255).astype(np.uint8) for p in parts]


class Decoder:
    """Pictures of a stream, chunk by chunk, each from the one before it."""

    def __init__(self, extra: bytes = b""):
        self.layer: Layer | None = None
        self.planes: list[np.ndarray] | None = None
        self.version = 1
        self.pictures(extra)

    def pictures(self, data: bytes) -> int:
        """Read a chunk; how many pictures it had. The last one is in `planes`."""
        at, n = data.find(b"\0\0\1"), 0
        while 0 <= at < len(data) - 3:
            kind, after = data[at + 3], at + 4
            following = data.find(b"\0\0\1", after)
            body = data[after : following if following >= 0 else len(data)]
            if 0x20 <= kind <= 0x2F:
                self.layer = layer(Bits(body), self.version)
            elif kind == 0xB5 and body and body[0] >> 7:
                self.version = body[0] >> 3 & 15
            elif kind == 0xB6:
                self._picture(Bits(body))
                n += 1
            at = following
        return n

    def _picture(self, bits: Bits) -> None:
        if self.layer is None:
            raise ValueError("a picture before its layer's header")
        kind = bits(2)
        while bits(1):
            pass
        bits(1 + self.layer.time_bits + 1)
        if kind > 1:
            raise ValueError(f"MPEG-4 video with {'BS'[kind - 2]} pictures is not decoded here")
        if kind == 1 and self.planes is None:
            raise ValueError("a P picture without a picture before it")
        if not bits(1):  # the same again
            if self.planes is None:
                raise ValueError("an empty picture without a picture before it")
            return
        rounding = bits(1) if kind else 0
        below, quantiser, reach = STEADY_BELOW[bits(3)], bits(5), bits(3) if kind else 1
        read = _Picture(bits, self.layer, quantiser, below, reach, bool(kind))
        read.read()
        self.planes = _made(read, self.planes if kind else None, rounding)

    def image(self) -> bytes:
        """The last picture as a JPEG image."""
        y, u, v = self.planes
        whole = np.stack([y, *(c.repeat(2, 0).repeat(2, 1) for c in (u, v))], axis=-1)
        return jpeg.encode(jpeg.full_range(whole[: self.layer.height, : self.layer.width]))


def images(file: BinaryIO) -> Iterator[bytes]:
    """The frames of an open AVI file's first video stream as JPEG images."""
    decoder, index = Decoder(extra_of(file)), frames_of(file)
    for at, size in zip(index.at.tolist(), index.size.tolist()):
        if (n := decoder.pictures(part(file, at, size))) != 1:
            raise ValueError(f"the chunk at byte {at} has {n} pictures")
        yield decoder.image()
