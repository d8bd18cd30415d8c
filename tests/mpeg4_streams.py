"""MPEG-4 streams written by hand from quantised blocks and vectors, and the pictures they stand for by plain loops."""

import random

import numpy as np

from lockstep.sources import mpeg4


class Out:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += f"{value & (1 << n) - 1:0{n}b}" if n else ""

    def code(self, codes, k):
        self.text += codes.split()[k]

    def data(self):
        whole = self.text + "0"
        whole += "1" * (-len(whole) % 8)
        return int(whole, 2).to_bytes(len(whole) // 8, "big")


def layer(width, height, resolution=25):
    out = Out()
    for value, n in ((0, 1), (1, 8), (1, 1), (1, 4), (1, 3), (1, 4), (0, 1), (0, 2), (1, 1), (resolution, 16), (1, 1), (0, 1), (1, 1), (width, 13), (1, 1), (height, 13), (1, 1), (0, 1), (1, 1), (0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (0, 1), (0, 1)):
        out.put(value, n)
    return b"\0\0\1\x00\0\0\1\x20" + out.data()


def scale(q, luma):
    return (8 if q < 5 else 2 * q if q < 9 else q + 8 if q < 25 else 2 * q - 16) if luma else (8 if q < 5 else (q + 13) // 2 if q < 25 else q - 6)


def nearest(a, b):
    return int(np.floor(abs(a) / b + 0.5)) * (1 if a >= 0 else -1)


def write_events(out, levels_of, codes, events, escapes):
    """events: (last, run, level) with signs; an escape of the kind asked for where it can stand for the event."""
    order = mpeg4.events(levels_of)
    place = {e: k for k, e in enumerate(order)}
    for last, run, level in events:
        size, minus = abs(level), int(level < 0)
        most = levels_of[last][run] if run < len(levels_of[last]) else 0
        longest = max((r for r, n in enumerate(levels_of[last]) if n >= size), default=-1)
        if size <= most and not escapes:
            out.code(codes, place[last, run, size])
            out.put(minus, 1)
        elif most and 0 < size - most <= most:
            out.code(codes, 102)
            out.put(0, 1)
            out.code(codes, place[last, run, size - most])
            out.put(minus, 1)
        elif longest >= 0 and 0 <= run - longest - 1 < len(levels_of[last]) and levels_of[last][run - longest - 1] >= size and max(r for r, n in enumerate(levels_of[last]) if n >= size) == longest:
            out.code(codes, 102)
            out.put(2, 2)
            out.code(codes, place[last, run - longest - 1, size])
            out.put(minus, 1)
        else:
            out.code(codes, 102)
            for value, n in ((3, 2), (last, 1), (run, 6), (1, 1), (level, 12), (1, 1)):
                out.put(value, n)


def events_of(values):
    at = [k for k, v in enumerate(values) if v]
    return [(int(k == at[-1]), k - (at[i - 1] + 1 if i else 0), values[k]) for i, k in enumerate(at)]


ZIGZAG = [y * 8 + x for d in range(15) for y, x in (lambda along: along if d % 2 else along[::-1])([(y, d - y) for y in range(max(0, d - 7), min(7, d) + 1)])]


def inverse(block):
    c = np.array([[(8**-0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    return np.rint(c.T @ np.array(block, float).reshape(8, 8) @ c).astype(int)


def unscaled(v, q):
    return 0 if not v else max(-2048, min(2047, (q * (2 * abs(v) + 1) - (q % 2 == 0)) * (1 if v > 0 else -1)))


class Stream:
    """Pictures one after another; `planes` is what the last one shows."""

    def __init__(self, width, height, seed):
        self.across, self.down, self.rng = -(-width // 16), -(-height // 16), random.Random(seed)
        self.planes = None

    def picture(self, kind, below=0, quantiser=5, reach=1, rounding=0, dense=6, big=False, escapes=False, flat=False):
        rng, out = self.rng, Out()
        for value, n in ((kind, 2), (0, 1), (1, 1), (0, 5), (1, 1), (1, 1)):
            out.put(value, n)
        if kind:
            out.put(rounding, 1)
        for value, n in ((below, 3), (quantiser, 5), *([(reach, 3)] if kind else [])):
            out.put(value, n)
        old = self.planes
        planes = [np.zeros((16 * self.down, 16 * self.across), int), *(np.zeros((8 * self.down, 8 * self.across), int) for _ in range(2))]
        vectors = {}
        intra = {}
        for y in range(self.down):
            for x in range(self.across):
                if not kind and rng.random() < 0.1:
                    out.code(mpeg4.INTRA_KINDS, 8)
                what = rng.choice([mpeg4.INTER, mpeg4.INTER_Q, mpeg4.INTER_4, mpeg4.INTRA, "skip"]) if kind else rng.choice([mpeg4.INTRA, mpeg4.INTRA_Q]) if not flat else mpeg4.INTRA
                if what == "skip":
                    out.put(1, 1)
                    vectors.update({(2 * y + i, 2 * x + j): (0, 0) for i in (0, 1) for j in (0, 1)})
                    self._predict(planes, old, y, x, vectors, rounding, None)
                    continue
                if kind:
                    out.put(0, 1)
                before = quantiser
                step = rng.choice((-1, -2, 1, 2)) if what in (mpeg4.INTER_Q, mpeg4.INTRA_Q) else 0
                if not 1 <= quantiser + step <= 31:
                    step = -step
                quantiser += step
                is_intra = what in (mpeg4.INTRA, mpeg4.INTRA_Q)
                blocks = [[0] * 64 for _ in range(6)]
                for b in blocks:
                    for _ in range(0 if flat or rng.random() < 0.3 else rng.randint(1, dense)):
                        b[rng.choice(ZIGZAG[1 if is_intra else 0 : rng.choice((6, 64))])] = rng.choice((-1, 1)) * (rng.randint(1, 300) if big and rng.random() < 0.3 else rng.choice((1, 1, 1, 2, 3, 9, 20)))
                if is_intra:
                    vectors.update({(2 * y + i, 2 * x + j): (0, 0) for i in (0, 1) for j in (0, 1)})
                    near = int(rng.random() < 0.6)
                    own = before < (99, 13, 15, 17, 19, 21, 23, 0)[below]
                    self._intra(out, planes, intra, y, x, what, kind, step, quantiser, near, own, blocks, escapes, flat)
                    continue
                pattern = sum(any(b) << 5 - k for k, b in enumerate(blocks))
                out.code(mpeg4.INTER_KINDS, {mpeg4.INTER: 0, mpeg4.INTER_Q: 4, mpeg4.INTER_4: 8}[what] + (pattern & 3))
                out.code(mpeg4.PATTERNS, 15 - (pattern >> 2))
                if step:
                    out.put({-1: 0, -2: 1, 1: 2, 2: 3}[step], 2)
                for k in range(4 if what == mpeg4.INTER_4 else 1):
                    self._vector(out, vectors, 2 * y + k // 2, 2 * x + k % 2, k, reach, what == mpeg4.INTER_4)
                for b in blocks:
                    if any(b):
                        write_events(out, mpeg4.INTER_LEVELS, mpeg4.INTER_EVENTS, events_of([b[k] for k in ZIGZAG]), escapes)
                self._predict(planes, old, y, x, vectors, rounding, [inverse([unscaled(v, quantiser) for v in b]) for b in blocks])
        self.planes = [np.clip(p, 0, 255) for p in planes]
        return b"\0\0\1\xb6" + out.data()

    def _places(self, y, x):
        return [*((0, 2 * y + k // 2, 2 * x + k % 2) for k in range(4)), (1, y, x), (2, y, x)]

    def _intra(self, out, planes, intra, y, x, what, kind, step, q, near, own, blocks, escapes, flat):
        written = []
        for place, b in zip(self._places(y, x), blocks):
            component, r, c = place
            s = scale(q, component == 0)
            left, corner, above = (intra.get((component, i, j)) for i, j in ((r, c - 1), (r - 1, c - 1), (r - 1, c)))
            dcs = [n["dc"] if n else 1024 for n in (left, corner, above)]
            up = abs(dcs[0] - dcs[1]) < abs(dcs[1] - dcs[2])
            guess = (dcs[2] if up else dcs[0]) // 1
            b[0] = (104 if flat else self.rng.randint(1, 2047 // s)) if not flat or component else 152
            diff = b[0] - (guess + s // 2) // s
            send = list(b)
            source = above if up else left
            if near and source:
                for k in range(1, 8):
                    at = k if up else 8 * k
                    send[at] -= nearest(source["q"][at] * source["step"], q)
            intra[place] = {"dc": b[0] * s, "q": list(b), "step": q}
            order = ZIGZAG if not near else mpeg4.FROM_ABOVE if up else mpeg4.FROM_LEFT
            values = [send[k] for k in order]
            values[0] = 0 if own else diff
            written.append((component, diff, values[1:] if own else values))
            pixels = inverse([b[0] * s, *(unscaled(v, q) for v in b[1:])])
            planes[component][8 * r : 8 * r + 8, 8 * c : 8 * c + 8] = pixels
        pattern = sum(any(v) << 5 - k for k, (_, _, v) in enumerate(written))
        if kind:
            out.code(mpeg4.INTER_KINDS, (12 if what == mpeg4.INTRA else 16) + (pattern & 3))
        else:
            out.code(mpeg4.INTRA_KINDS, (0 if what == mpeg4.INTRA else 4) + (pattern & 3))
        out.put(near, 1)
        out.code(mpeg4.PATTERNS, pattern >> 2)
        if step:
            out.put({-1: 0, -2: 1, 1: 2, 2: 3}[step], 2)
        for component, diff, values in written:
            if own:
                n = abs(diff).bit_length()
                out.code(mpeg4.CHROMA_SIZES if component else mpeg4.LUMA_SIZES, n)
                out.put(diff if diff > 0 else diff + (1 << n) - 1, n)
                if n > 8:
                    out.put(1, 1)
            if any(values):
                write_events(out, mpeg4.INTRA_LEVELS, mpeg4.INTRA_EVENTS, events_of(values), escapes)

    def _vector(self, out, vectors, r, c, k, reach, four):
        at = [(r, c - 1), (r - 1, c), [(r - 1, c + 2), (r - 1, c + 1), (r - 1, c + 1), (r - 1, c - 1)][k]]
        near = [vectors[p] if p[0] >= 0 and 0 <= p[1] < 2 * self.across else None for p in at]
        good = [v for v in near if v is not None]
        near = [v if v is not None else good[0] if len(good) == 1 else (0, 0) for v in near]
        low, high = -(32 << reach - 1), (32 << reach - 1) - 1
        vector = tuple(self.rng.choice((0, 0, self.rng.randint(-5, 5), self.rng.randint(low, high))) for _ in range(2))
        for i in (0, 1):
            guess = sorted(v[i] for v in near)[1]
            diff = vector[i] - guess
            span = high - low + 1
            diff = diff - span if diff > high else diff + span if diff < low else diff
            size = abs(diff)
            if reach == 1 or not size:
                out.code(mpeg4.VECTORS, size)
                if size:
                    out.put(int(diff < 0), 1)
            else:
                out.code(mpeg4.VECTORS, (size - 1 >> reach - 1) + 1)
                out.put(int(diff < 0), 1)
                out.put(size - 1 & (1 << reach - 1) - 1, reach - 1)
        for p in [(r, c)] if four else [(r + i, c + j) for i in (0, 1) for j in (0, 1)]:
            vectors[p] = vector

    def _predict(self, planes, old, y, x, vectors, rounding, rest):
        four = [vectors[2 * y + k // 2, 2 * x + k % 2] for k in range(4)]
        halves = [0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2]
        chroma = []
        for i in (0, 1):
            total = sum(v[i] for v in four)
            chroma.append((2 * (abs(total) // 16) + halves[abs(total) % 16]) * (1 if total >= 0 else -1))
        for k, (component, r, c) in enumerate(self._places(y, x)):
            mx, my = four[k] if k < 4 else chroma
            plane = old[component]
            at = lambda i, j, p=plane: int(p[min(max(i, 0), p.shape[0] - 1), min(max(j, 0), p.shape[1] - 1)])
            for i in range(8):
                for j in range(8):
                    yy, xx = 8 * r + i + (my >> 1), 8 * c + j + (mx >> 1)
                    some = [at(yy + a, xx + b) for a in range(1 + (my & 1)) for b in range(1 + (mx & 1))]
                    value = (sum(some) + len(some) // 2 - (rounding if len(some) > 1 else 0)) // len(some)
                    planes[component][8 * r + i, 8 * c + j] = value + (rest[k][i, j] if rest else 0)
