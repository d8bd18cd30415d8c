"""Small AVI files, made by hand."""

import struct

VIEWS = (("view1", "view1.avi", 3), ("view2", "view2.avi", 0), ("view3", "view3.avi", 1))


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def movie(images, width=36, height=28, codec=b"MJPG", index="", keys=None, second=()):
    """An AVI with an audio stream before the video stream. index: none, idx1 from the movi list or absolute, or opendml; second: frames of another RIFF list."""
    def header(kind, code, scale, rate, n):
        return kind + code + struct.pack("<IHHIIIIIIII8x", 0, 0, 0, 0, scale, rate, 0, n, 0, 0, 0)

    sound = chunk(b"LIST", b"strl" + chunk(b"strh", header(b"auds", b"\0\0\0\0", 1, 8000, 9)) + chunk(b"strf", b"\0" * 18))
    size = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, codec, 0, 0, 0, 0, 0)
    indx = b""
    per = max(1, len(images) // 2)
    parts = [images[k : k + per] for k in range(0, len(images), per)] if index == "opendml" else []
    if parts:
        indx = chunk(b"indx", struct.pack("<HBBI4s12x", 4, 0, 0, len(parts), b"01dc") + b"".join(struct.pack("<QII", 0, 0, 0) for _ in parts))
    film = chunk(b"LIST", b"strl" + chunk(b"strh", header(b"vids", codec, 1, 25, len(images))) + chunk(b"strf", size) + indx)
    lists = b"AVI " + chunk(b"LIST", b"hdrl" + sound + film)
    movi, table, spans, key = b"movi", b"", [], lambda k: keys is None or k in keys
    start = 8 + len(lists) + 8  # of the movi list's name
    for k, i in enumerate(images):
        movi += chunk(b"00wb", b"zz")
        place = len(movi)
        movi += chunk(b"01dc", i)
        table += struct.pack("<4sIII", b"01dc", 0x10 * key(k), place + (start if index == "absolute" else 0), len(i))
        spans.append((start + place + 8, len(i) | (0 if key(k) else 1 << 31)))
    for k, own in enumerate(parts):
        body = struct.pack("<HBBI4sQ4x", 2, 0, 1, len(own), b"01dc", start) + b"".join(struct.pack("<II", a - start, n) for a, n in spans[k * per : k * per + per])
        lists = lists.replace(struct.pack("<QII", 0, 0, 0), struct.pack("<QII", start + len(movi), len(body) + 8, len(own)), 1)
        movi += chunk(b"ix01", body)
    whole = chunk(b"RIFF", lists + chunk(b"LIST", movi) + (chunk(b"idx1", table) if index in ("idx1", "absolute") else b""))
    return whole + (chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + b"".join(chunk(b"01dc", i) for i in second))) if second else b"")


def image(view, k):
    return b"\xff\xd8" + f"{view}:{k}".encode() + b"\xff\xd9"
