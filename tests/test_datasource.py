import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.operators.registry import registry
from lockstep.sources import avi, datasource, jpeg, video
from movies import VIEWS, chunk, image, movie


@pytest.fixture(scope="module")
def formats(spark):
    datasource.register(spark)
    return spark


@pytest.fixture
def folder(tmp_path):
    for view, name, _ in VIEWS:
        (tmp_path / name).write_bytes(movie([image(view, k) for k in range(6)], index="idx1"))
    return tmp_path


@pytest.mark.parametrize("index", ["", "idx1", "absolute", "opendml"])
def test_index_and_walk_find_the_same_frames(index):
    images = [image("a", k) * (k + 1) if k % 4 else b"" for k in range(40)]
    whole = movie(images, index=index)
    want = [i for i in images if i]
    found = avi.frames_of(io.BytesIO(whole))
    assert [whole[a : a + n] for a, n in zip(found.at, found.size)] == want and list(video.read_frames(whole)) == want
    # cut off in its frames, a file has no index any more
    short = whole[: whole.index(images[30]) + 3]
    assert list(video.read_frames(short)) == [i for i in images[:30] if i]


def test_padding_and_broken_recordings(tmp_path):
    images = [image("a", k) for k in range(4)]
    whole = movie(images)
    assert list(video.read_frames(whole + b"\0" * 4_000_000)) == images
    # sizes that were never filled in, and room that was made beforehand
    at = whole.index(b"movi") - 4
    open_ended = whole[:4] + b"\0\0\0\0" + whole[8:at] + b"\0\0\0\0" + whole[at + 4 :]
    assert list(video.read_frames(open_ended + b"\0" * 4_000_000)) == images
    assert list(video.read_frames(movie(images, second=[image("b", 0)]))) == [*images, image("b", 0)]


def test_key_frames_of_an_index():
    frames = avi.frames_of(io.BytesIO(movie([bytes([k + 1]) * 100 for k in range(10)], codec=b"XVID", index="idx1", keys={0, 4, 8})))
    assert np.flatnonzero(frames.key).tolist() == [0, 4, 8]
    assert video.key_ranges(frames, 1) == [(0, 4), (4, 8), (8, 10)] and video.key_ranges(frames, 500) == [(0, 8), (8, 10)] and video.key_ranges(frames) == [(0, 10)]
    assert video.key_ranges(avi.frames_of(io.BytesIO(movie([b"x"] * 3, codec=b"XVID"))), 1) == [(0, 3)]
    whole = movie([bytes([k + 1]) * (100 + k) for k in range(10)], codec=b"XVID", index="opendml", keys={0, 4})
    piece = b"".join(avi.excerpt(io.BytesIO(whole), avi.frames_of(io.BytesIO(whole)), 1, 4, 7))
    got = avi.frames_of(io.BytesIO(piece))
    assert [piece[a : a + n] for a, n in zip(got.at, got.size)] == [bytes([k + 1]) * (100 + k) for k in (4, 5, 6)]
    assert avi.header_of(io.BytesIO(piece))["codec_name"] == "mpeg4" and struct.unpack("<I", piece[4:8])[0] == len(piece) - 8


def test_several_tasks_read_one_file(spark, tmp_path):
    images = [image("a", k) + bytes(1000) for k in range(64)]
    (tmp_path / "a.avi").write_bytes(movie(images, index="idx1"))
    views = registry(spark, [("a", "a.avi", 5)])
    one, many = (video.frames(spark, views, str(tmp_path), split=s) for s in (1 << 30, 8000))
    assert sorted((r.n, bytes(r.image)) for r in one.collect()) == sorted((r.n, bytes(r.image)) for r in many.collect()) == list(enumerate(images))
    parts = many.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(parts) == 9 and max(p["count"] for p in parts) <= 20
    got = video.frames(spark, views, str(tmp_path), trimmed=True)
    assert [r.n for r in got.orderBy("n").collect()] == list(range(5, 64))


def test_dropped_frames_are_not_read(spark, tmp_path):
    """A chunk that is no image fails only where it is read."""
    (tmp_path / "a.avi").write_bytes(movie([b"no image", image("a", 1), image("a", 2)], index="idx1"))
    views = registry(spark, [("a", "a.avi", 1)])
    assert video.frames(spark, views, str(tmp_path), trimmed=True).count() == 2 and video.entries(spark, views, str(tmp_path)).count() == 3
    with pytest.raises(Exception, match="not a JPEG"):
        video.frames(spark, views, str(tmp_path)).collect()


def test_reading_by_format(formats, folder):
    got = formats.read.format("avi").load(str(folder))
    assert sorted((r.view, r.n, bytes(r.image)) for r in got.collect()) == sorted((v, k, image(v, k)) for v, _, _ in VIEWS for k in range(6))
    small = formats.read.format("avi").option("split", 100).load(str(folder))
    assert small.rdd.getNumPartitions() > 12 and sorted((r.view, r.n) for r in small.select("view", "n").collect()) == sorted((v, k) for v, _, _ in VIEWS for k in range(6))
    rows = formats.read.format("avi_headers").load(str(folder)).orderBy("view").collect()
    assert [(r.view, r.filename, r.codec_name, r.width, r.nb_frames) for r in rows] == [(v, n, "mjpeg", "36", "6") for v, n, _ in VIEWS]
    with pytest.raises(Exception, match="nowhere"):
        formats.read.format("avi").load(str(folder / "nowhere")).count()


def test_conditions_reach_the_reader(formats, tmp_path):
    """What conditions leave out would fail if it were read: a first frame that is no image, and a file that is no video of images."""
    (tmp_path / "a.avi").write_bytes(movie([b"no image", *(image("a", k) for k in range(1, 6))], index="idx1"))
    (tmp_path / "b.avi").write_bytes(movie([b"x"] * 3, codec=b"H264"))
    read = formats.read.format("avi").load(str(tmp_path))
    kept = read.where("view = 'a' AND n >= 1")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan avi" in plan and "Filter (" not in plan
    assert sorted(r.n for r in kept.collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.n for r in read.where("view in ('a', 'z') AND n > 2 AND n < 5").collect()) == [3, 4]
    assert [bytes(r.image) for r in read.where("view = 'a' AND n = 4").collect()] == [image("a", 4)]
    assert read.where("view = 'c'").count() == 0 and read.where("view = 'a' AND n > 10").count() == 0
    # without the images no frame is read
    assert formats.read.format("avi").schema("view string, n long").load(str(tmp_path / "a.avi")).count() == 6
    with pytest.raises(Exception, match="not a JPEG"):
        read.where("view = 'a'").collect()


def test_pushed_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains

    reader = datasource.AviReader([("/x/a.avi", 250), ("/x/b.avi", 10)], ["view", "n"], 100)
    rest = StringContains(("view",), "a")
    assert list(reader.pushFilters([rest, IsNotNull(("n",)), GreaterThan(("n",), 3), LessThanOrEqual(("n",), 9), LessThanOrEqual(("n",), 7), In(("view",), ("a", "c"))])) == [rest]
    assert (reader.first, reader.last) == (4, 7) and [(p.path, p.start) for p in reader.partitions()] == [("/x/a.avi", 0), ("/x/a.avi", 100), ("/x/a.avi", 200)]
    assert list(reader.pushFilters([EqualTo(("view",), "b")])) == [] and reader.partitions() == []


SCHEMA = "view string, frame_idx long, image binary"


def test_writing_by_format(formats, tmp_path):
    at = tmp_path / "data"
    put = lambda rows, mode, **options: formats.createDataFrame(rows, SCHEMA).repartition(3).write.format("frame_files").options(**options).mode(mode).save(str(at))
    put([(v, k, image(v, k)) for v in "ab" for k in range(7)], "overwrite")
    names = lambda v: sorted(p.name for p in (at / v).iterdir() if not p.name.startswith("."))
    assert names("a") == [datasource.MARK, *(f"frame_{k:04d}.jpg" for k in range(7))] and datasource.promised(str(at / "a")) == {"frames": 7, "note": None}
    (at / "a" / "notes.txt").write_text("x")
    # fewer frames, and a view without any
    put([("a", k, image("new", k)) for k in range(3)], "overwrite", views='{"a": 3, "b": "x"}')
    assert names("a") == [datasource.MARK, "frame_0000.jpg", "frame_0001.jpg", "frame_0002.jpg", "notes.txt"] and names("b") == [datasource.MARK]
    assert (at / "a/frame_0001.jpg").read_bytes() == image("new", 1) and datasource.promised(str(at / "b")) == {"frames": 0, "note": "x"}
    put([("a", 12345, image("new", 5))], "append")
    assert "frame_12345.jpg" in names("a") and len(names("a")) == 6 and datasource.promised(str(at / "a"))["frames"] == 4 and datasource.promised(str(at)) is None
    assert sorted(p.name for p in at.iterdir()) == ["a", "b"]


def test_a_failing_job_leaves_the_old_frames(formats, tmp_path):
    at = tmp_path / "data"
    good = formats.createDataFrame([("a", k, image("a", k)) for k in range(5)], SCHEMA)
    good.write.format("frame_files").mode("overwrite").save(str(at))
    bad = formats.createDataFrame([("a", k, image("b", k) if k != 4 else b"x") for k in range(5)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="JPEG"):
        bad.write.format("frame_files").mode("overwrite").save(str(at))
    assert sorted(p.name for p in at.iterdir()) == ["a"] and all((at / f"a/frame_{k:04d}.jpg").read_bytes() == image("a", k) for k in range(5))


def test_uncompressed_video_becomes_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    pictures = [rng.integers(0, 256, (28, 36, 3), np.uint8) for _ in range(3)]
    raw = [np.ascontiguousarray(p[::-1, :, ::-1]).tobytes() for p in pictures]
    (tmp_path / "a.avi").write_bytes(movie(raw, codec=b"\0\0\0\0", index="idx1"))
    views = registry(spark, [("a", "a.avi", 1)])
    assert video.headers(spark, views, str(tmp_path)).first()["codec_name"] == "rawvideo"
    got = {r.n: bytes(r.image) for r in video.frames(spark, views, str(tmp_path)).collect()}
    assert got == {k: jpeg.encode(jpeg.from_rgb(p)) for k, p in enumerate(pictures)}
    assert list(video.jpegs(io.BytesIO(b"".join(got.values())))) == list(got.values())
