import struct

import numpy as np
import pytest

from lockstep.sources import jpeg


def decoded(image):
    """A plain reader of baseline images without subsampling: (height, width, components)."""
    at, tables, steps = 2, {}, None
    while True:
        mark, size = struct.unpack_from(">HH", image, at)
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xFFDB:
            steps = list(body[1:65])
        elif mark == 0xFFC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
        elif mark == 0xFFC4:
            counts, symbols, code, k, own = body[1:17], body[17:], 0, 0, {}
            for bits, count in enumerate(counts, 1):
                for _ in range(count):
                    own[bits, code] = symbols[k]
                    code, k = code + 1, k + 1
                assert code <= (1 << bits) - 1
                code <<= 1
            tables[body[0] >> 4] = own
        elif mark == 0xFFDA:
            break
    bits = "".join(f"{b:08b}" for b in image[at:-2].replace(b"\xff\0", b"\xff"))
    place = 0

    def symbol(table):
        nonlocal place
        code = 0
        for k in range(1, 17):
            code = code * 2 + int(bits[place])
            place += 1
            if (k, code) in table:
                return table[k, code]
        raise AssertionError

    def number(k):
        nonlocal place
        if not k:
            return 0
        v = int(bits[place : place + k], 2)
        place += k
        return v if v >> (k - 1) else v - (1 << k) + 1

    order = []
    for d in range(15):
        along = [(y, d - y) for y in range(max(0, d - 7), min(7, d) + 1)]
        order += along if d % 2 else along[::-1]
    out, last = np.zeros((-(-height // 8) * 8, -(-width // 8) * 8, n)), [0] * n
    cosine = np.array([[(8**-0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    for y in range(0, len(out), 8):
        for x in range(0, out.shape[1], 8):
            for c in range(n):
                block = np.zeros((8, 8))
                last[c] += number(symbol(tables[0]))
                block[0, 0] = last[c] * steps[0]
                k = 1
                while k < 64:
                    s = symbol(tables[1])
                    if s == 0:
                        break
                    k += s >> 4
                    if s != 0xF0:
                        block[order[k]] = number(s & 15) * steps[k]
                    k += 1
                out[y : y + 8, x : x + 8, c] = cosine.T @ block @ cosine + 128
    assert set(bits[place:]) <= {"1"} and len(bits) - place < 8
    return out[:height, :width]


def pictures():
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:28, :36]
    smooth = np.stack([128 + 100 * np.sin(x / 9), 90 + y * 2.0, 200 - x * 1.5], axis=-1)
    return {
        "smooth": smooth, "noise": rng.uniform(0, 255, (17, 23, 3)), "flat": np.full((8, 8, 3), 77.0), "black": np.zeros((9, 1, 3)), "grey": rng.uniform(100, 130, (16, 16, 1)),
        "edges": np.where((x + y) % 5 == 0, 255.0, 0.0)[..., None].repeat(3, 2), "sparse": np.where((x == 3) & (y == 3), 255.0, 128.0)[..., None],
    }


@pytest.mark.parametrize("name", pictures())
def test_pictures_come_back_within_the_quantisation(name):
    planes = pictures()[name]
    image = jpeg.encode(planes)
    assert image[:2] == b"\xff\xd8" and image[-2:] == b"\xff\xd9"
    got = decoded(image)
    assert got.shape == planes.shape
    # a block's error is at most half a step in each of its 64 frequencies
    whole = np.pad(got - planes, ((0, -planes.shape[0] % 8), (0, -planes.shape[1] % 8), (0, 0)))
    for y in range(0, len(whole), 8):
        for x in range(0, whole.shape[1], 8):
            assert (whole[y : y + 8, x : x + 8] ** 2).sum(axis=(0, 1)).max() <= (jpeg.STEPS**2).sum() / 4 + 1e-6


def test_codes_are_short_enough():
    fibonacci, a, b = {}, 1, 1
    for k in range(40):
        fibonacci[k] = a
        a, b = b, a + b
    size = jpeg.lengths(fibonacci)
    assert max(size.values()) <= 16 and sum(2.0**-d for d in size.values()) < 1 and set(size) == set(range(40))
    assert jpeg.lengths({5: 9}) == {5: 1}


def test_uncompressed_frames():
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (6, 5, 3), np.uint8)
    rows = np.zeros((6, 16), np.uint8)
    rows[:, :15] = rgb[..., ::-1].reshape(6, 15)
    want = jpeg.from_rgb(rgb)
    assert np.allclose(jpeg.picture(rows.tobytes(), "DIB", 5, 6), want) and np.allclose(jpeg.picture(rows[::-1].tobytes(), "DIB", 5, 6, 24, True), want)
    wide = np.concatenate([rgb[..., ::-1], np.zeros((6, 5, 1), np.uint8)], axis=-1)
    assert np.allclose(jpeg.picture(wide.tobytes(), "DIB", 5, 6, 32), want)
    assert np.allclose(want[0, 0], [0.299 * rgb[0, 0, 0] + 0.587 * rgb[0, 0, 1] + 0.114 * rgb[0, 0, 2], *want[0, 0, 1:]])
    y, u, v = np.full((4, 6), 235, np.uint8), np.full((2, 3), 128, np.uint8), np.full((2, 3), 240, np.uint8)
    full = jpeg.picture(y.tobytes() + u.tobytes() + v.tobytes(), "I420", 6, 4)
    assert full.shape == (4, 6, 3) and np.allclose(full[0, 0], [255, 128, 255.5])
    packed = np.stack([y[:, ::2], u.repeat(2, 0), y[:, 1::2], v.repeat(2, 0)], axis=-1)
    assert np.allclose(jpeg.picture(packed.tobytes(), "YUY2", 6, 4), full)
    for bad in (("DIB", 24), ("DIB", 8), ("I420", 12), ("YUY2", 16), ("XXXX", 24)):
        with pytest.raises(ValueError, match="no frame"):
            jpeg.picture(b"123", bad[0], 6, 4, bad[1])
