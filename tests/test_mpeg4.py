import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.operators.registry import registry
from lockstep.plans import extract
from lockstep.sources import avi, config, datasource, jpeg, mpeg4, video
from mpeg4_streams import Stream, layer
from movies import chunk, movie
from test_jpeg import decoded

TABLES = ("INTRA_KINDS", "INTER_KINDS", "PATTERNS", "VECTORS", "LUMA_SIZES", "CHROMA_SIZES", "INTRA_EVENTS", "INTER_EVENTS")


@pytest.mark.parametrize("name", TABLES)
def test_codes_can_be_told_apart(name):
    codes = getattr(mpeg4, name).split()
    assert not [(a, b) for a in codes for b in codes if a != b and b.startswith(a)] and 0.95 < sum(2.0 ** -len(c) for c in codes) <= 1


def test_tables_of_coefficients_share_their_codes():
    assert set(mpeg4.INTRA_EVENTS.split()) == set(mpeg4.INTER_EVENTS.split())
    assert sorted(mpeg4.FROM_ABOVE) == sorted(mpeg4.FROM_LEFT) == sorted(mpeg4.ZIGZAG) == list(range(64))


def test_flat_picture():
    """All luma 152 * 2q / 8, all chroma 104 * (q + 13) // 2 / 8 at quantiser 5."""
    stream, decoder = Stream(36, 20, 1), mpeg4.Decoder()
    assert decoder.pictures(layer(36, 20) + stream.picture(0, flat=True)) == 1
    assert [p.shape for p in decoder.planes] == [(32, 48), (16, 24), (16, 24)]
    assert [set(p.ravel().tolist()) for p in decoder.planes] == [{190}, {117}, {117}]


@pytest.mark.parametrize("seed", range(6))
def test_intra_pictures(seed):
    """Steady parts with codes of their own or among the coefficients, prediction from above and left across quantisers, all escapes."""
    stream, decoder = Stream(70, 50, seed), mpeg4.Decoder(layer(70, 50))
    for below, quantiser, big, escapes in ((0, 3, False, False), (7, 12, True, False), (3, 16, False, True), (0, 30, True, True), (1, 1, True, True)):
        decoder.pictures(stream.picture(0, below=below, quantiser=quantiser, big=big, escapes=escapes))
        assert all((a == b).all() for a, b in zip(decoder.planes, stream.planes))


@pytest.mark.parametrize("seed", range(6))
def test_predicted_pictures(seed):
    """One and four vectors of every reach, out of the picture too, intra macroblocks between, both roundings."""
    stream, decoder = Stream(52, 36, 10 + seed), mpeg4.Decoder(layer(52, 36))
    decoder.pictures(stream.picture(0, quantiser=4))
    for k, (reach, rounding) in enumerate(((1, 0), (1, 1), (2, 0), (4, 1))):
        decoder.pictures(stream.picture(1, quantiser=3 + 7 * k, reach=reach, rounding=rounding, below=k, big=k % 2 == 1, escapes=k > 1))
        assert all((a == b).all() for a, b in zip(decoder.planes, stream.planes))
    before = [p.copy() for p in decoder.planes]
    assert decoder.pictures(b"\0\0\1\xb6" + bytes([0b01010000, 0b01011111])) == 1 and all((a == b).all() for a, b in zip(decoder.planes, before))


def test_what_is_not_decoded():
    stream = Stream(20, 20, 3)
    picture = stream.picture(0)
    for bad, match in ((picture, "before its layer"), (layer(20, 20) + stream.picture(1), "without a picture"), (layer(20, 20) + picture[:12], "ends before|no code|64 coefficients"), (layer(20, 20) + picture[:4] + bytes([0x90 | picture[4] & 15]) + picture[5:], "B pictures")):
        with pytest.raises(ValueError, match=match):
            mpeg4.Decoder().pictures(bad)


def film(width, height, n, every, seed=5):
    """(chunks, planes of each) of a stream with a key frame every few."""
    stream, coded, planes = Stream(width, height, seed), [], []
    for k in range(n):
        key = k % every == 0
        coded.append((layer(width, height) if key else b"") + stream.picture(0 if key else 1, quantiser=6, dense=3, rounding=k % 2))
        planes.append(stream.planes)
    return coded, planes


def shown(planes, width, height):
    whole = np.stack([planes[0], *(p.repeat(2, 0).repeat(2, 1) for p in planes[1:])], axis=-1)[:height, :width]
    return jpeg.full_range(whole)


def test_video_is_extracted_without_a_command(spark, tmp_path):
    """Key ranges are decoded by several tasks; the frames on disk show the stream's pictures."""
    (tmp_path / "raw_videos").mkdir()
    coded, planes = film(36, 20, 12, 4)
    own = {"view1": (3, b"FMP4"), "view2": (0, b"XVID"), "view3": (5, b"FMP4")}
    for view, (_, code) in own.items():
        (tmp_path / f"raw_videos/{view}.avi").write_bytes(movie(coded, 36, 20, code, index="idx1", keys={0, 4, 8}))
    views = registry(spark, [(v, f"{v}.avi", k) for v, (k, _) in own.items()])
    at = config.roots(str(tmp_path))
    parts = video.frames(spark, views, at.raw_videos, split=1)
    assert parts.withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 6
    rows = extract.extract(spark, at, views, f"{at.root}/metadata").collect()
    assert [(r["frame_count"], r["resolution"]) for r in rows] == [(9, "36x20"), (12, "36x20"), (7, "36x20")]
    for view, (offset, _) in own.items():
        for k in (0, 6):
            got = decoded((tmp_path / f"data/{view}/frame_{k:04d}.jpg").read_bytes())
            assert got.shape == (20, 36, 3) and np.abs(got - np.clip(shown(planes[k + offset], 36, 20), 0, 255))[..., 0].mean() < 6
    datasource.register(spark)
    read = spark.read.format("avi").option("split", 3000).load(at.raw_videos)
    got = {(r.view, r.n): bytes(r.image) for r in read.where("view <> 'view3' AND n >= 2 AND n < 11").collect()}
    want = {(r.view, r.n): bytes(r.image) for r in parts.collect()}
    assert read.rdd.getNumPartitions() > 6 and got == {k: v for k, v in want.items() if k[0] != "view3" and 2 <= k[1] < 11}
    # frames that are gone are made again from their key frame
    (tmp_path / "data/view1/frame_0002.jpg").unlink()
    assert [r["frame_count"] for r in extract.extract(spark, at, views, f"{at.root}/metadata", complete=True).collect()] == [9, 12, 7]


def test_key_frames_without_an_index():
    coded, _ = film(36, 20, 7, 3)
    found = avi.frames_of(io.BytesIO(movie(coded, 36, 20, b"FMP4")))
    assert np.flatnonzero(found.key).tolist() == [0, 3, 6] and video.key_ranges(found, 0) == [(0, 3), (3, 6), (6, 7)]
    assert not avi.frames_of(io.BytesIO(movie([b"\0\0\1\xb6\x50", b"x"], 36, 20, b"FMP4"))).key.any()


def test_headers_beside_the_stream():
    """A layer's header that is in the format chunk only."""
    coded, _ = film(36, 20, 3, 9)
    head = layer(36, 20)
    plain = movie([coded[0][len(head) :], *coded[1:]], 36, 20, b"FMP4")
    at = plain.index(b"strf", plain.index(b"FMP4"))
    old = plain[at : at + 8 + 40]
    new = chunk(b"strf", plain[at + 8 : at + 48] + head)
    grown = plain.replace(old, new)
    for name in (b"RIFF", b"hdrl", b"strl"):  # sizes of what it lies in
        k = grown.rindex(name, 0, at) if name != b"RIFF" else 0
        k = k if name == b"RIFF" else k - 8
        size = int.from_bytes(grown[k + 4 : k + 8], "little") + len(new) - len(old)
        grown = grown[: k + 4] + size.to_bytes(4, "little") + grown[k + 8 :]
    want = list(mpeg4.images(io.BytesIO(movie(coded, 36, 20, b"FMP4"))))
    assert list(mpeg4.images(io.BytesIO(grown))) == want and len(want) == 3
    with pytest.raises(ValueError, match="before its layer"):
        list(mpeg4.images(io.BytesIO(plain)))
