import io
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from lockstep.operators import align, manifest
from lockstep.operators.registry import registry
from lockstep.plans import extract
from lockstep.sources import config, frames, video
from movies import VIEWS, chunk, image, movie

@pytest.fixture
def project(tmp_path):
    at = config.roots(str(tmp_path))
    (tmp_path / "raw_videos").mkdir()
    for view, name, _ in VIEWS:
        (tmp_path / "raw_videos" / name).write_bytes(movie([image(view, k) for k in range(6)]))
    return at


def test_roots(tmp_path, monkeypatch):
    monkeypatch.delenv("DRIVE_ROOT", raising=False)
    with pytest.raises(KeyError):
        config.roots(env_file=str(tmp_path / "none"))
    (tmp_path / ".env").write_text("# x\nDRIVE_ROOT='/data/x/'\n")
    at = config.roots(env_file=str(tmp_path / ".env"))
    assert (at.raw_videos, at.data, at.logs, at.checkpoints) == ("/data/x/raw_videos", "/data/x/data", "/data/x/logs", "/data/x/checkpoints")
    monkeypatch.setenv("DRIVE_ROOT", "/y")
    assert config.roots().source("a.avi") == "/y/raw_videos/a.avi" and config.roots().frames("v") == "/y/data/v"


def test_headers_and_frames(spark, project):
    views = registry(spark, VIEWS)
    rows = extract.inspect(spark, project, views, f"{project.root}/inspection").collect()
    assert [tuple(r) for r in rows] == [(v, n, "mjpeg", "36", "28", "25/1", "0.240000", "6") for v, n, _ in VIEWS]
    got = video.frames(spark, views, project.raw_videos).collect()
    assert sorted((r["view"], r["n"], bytes(r["image"])) for r in got) == sorted((v, k, image(v, k)) for v, _, _ in VIEWS for k in range(6))


def test_header_of_other_bytes():
    assert video.read_header(b"") == {} and video.read_header(b"RIFF\0\0\0\0WAVE") == {}
    assert video.read_header(movie([], codec=b"FMP4"))["codec_name"] == "mpeg4"
    whole = movie([image("a", k) for k in range(3)])
    assert list(video.read_frames(whole[:-10])) == [image("a", 0), image("a", 1)]


def test_frames_that_are_no_images(spark, project, tmp_path):
    """Other codecs fail, as do chunks that are no JPEG; empty chunks are no frames; nothing is written."""
    coded = movie([b"\0\0\1\xb6" + bytes([k]) for k in range(3)], codec=b"H264")
    with pytest.raises(ValueError, match="h264"):
        list(video.read_frames(coded))
    with pytest.raises(ValueError, match="layer"):
        list(video.read_frames(movie([b"\0\0\1\xb6" + bytes([k]) for k in range(3)], codec=b"XVID")))
    with pytest.raises(ValueError, match="not a JPEG"):
        list(video.read_frames(movie([image("a", 0), b"\0\0\1\xb6"])))
    assert list(video.read_frames(movie([image("a", 0), b"", image("a", 1)]))) == [image("a", 0), image("a", 1)]
    assert list(video.read_frames(b"")) == []
    (tmp_path / "raw_videos" / "view1.avi").write_bytes(coded)
    views = registry(spark, VIEWS)
    with pytest.raises(Exception, match="need a decoder"):
        extract.extract(spark, project, views, f"{project.root}/metadata")
    assert not (tmp_path / "metadata").exists() and not list((tmp_path / "data").glob("view1/*"))
    # with a decoder, here one that makes an image of each chunk
    one = [str(tmp_path / "decoder.py"), tmp_path / "decoder.py"]
    one[1].write_text("import sys\nraw = sys.stdin.buffer.read()\nfor k in range(raw.count(b'00dc') + raw.count(b'01dc')): sys.stdout.buffer.write(b'\\xff\\xd8' + b'\\xff\\xda\\0\\2' + bytes([k]) + b'\\xff\\xd9')\n")
    rows = extract.extract(spark, project, views, f"{project.root}/metadata", decode=video.external_decoder(["python", one[0]])).collect()
    assert [(r["view"], r["frame_count"]) for r in rows] == [("view1", 0), ("view2", 6), ("view3", 5)]


def test_write_only_images(spark, tmp_path):
    for bad in (b"", b"\0\0\1\xb6"):
        with pytest.raises(Exception, match="JPEG"):
            frames.write_frame_files(spark.createDataFrame([("a", 0, bad)], "view string, frame_idx long, image binary"), str(tmp_path / "x"))
    frames.write_frame_files(spark.createDataFrame([("a", 0, image("a", 0))], "view string, frame_idx long, image binary"), f"file://{tmp_path}/y")
    assert (tmp_path / "y/a/frame_0000.jpg").read_bytes() == image("a", 0) and len(list((tmp_path / "y/a").iterdir())) <= 2
    with pytest.raises(ValueError, match="can't write"):
        frames.write_frame_files(spark.createDataFrame([("a", 0, image("a", 0))], "view string, frame_idx long, image binary"), "viewfs://x/y")


def picture(seed, thumbnail=b""):
    """The shape of a JPEG: a segment that may hold a thumbnail, a scan with stuffed bytes and restarts."""
    body = bytes((seed * k) % 255 for k in range(seed * 7 % 90))
    app = b"\xff\xd8" + thumbnail + b"\xff\xd9" if thumbnail else b"x"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda\0\2" + body + b"\xff\0\xff\xd3" + body + b"\xff\xd9"


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 16])
def test_images_of_a_pipe(monkeypatch, piece):
    monkeypatch.setattr(video, "PIECE", piece)
    want = [picture(k, picture(k + 1) if k % 2 else b"") for k in range(1, 9)]
    assert list(video.jpegs(io.BytesIO(b"".join(want)))) == want and list(video.jpegs(io.BytesIO(b""))) == []
    for bad in (want[0][:-1], want[0][:5], b"abcd", want[1] + b"\xff\xd8\xff"):
        with pytest.raises(ValueError):
            list(video.jpegs(io.BytesIO(bad)))


def test_failing_decoder_is_not_taken_for_no_frames():
    one = "import sys, os, signal; sys.stdout.buffer.write(bytes.fromhex('ffd8ffda0002ffd9')); sys.stdout.flush(); "
    for end in ("sys.exit(3)", "os.kill(os.getpid(), signal.SIGKILL)"):
        with pytest.raises(subprocess.CalledProcessError):
            list(video.external_decoder(["python", "-c", one + end])(io.BytesIO(b"x" * (1 << 20))))
    # a caller that wants no more is no failure
    decoder = video.external_decoder(["python", "-c", f"{one}\nwhile True: sys.stdout.buffer.write(bytes.fromhex('ffd8ffda0002ffd9'))"])
    assert next(images := decoder(io.BytesIO(b"x"))).startswith(video.BEGIN)
    images.close()


def test_headers_read_the_first_bytes_only(spark, tmp_path):
    """A long file is not read for its header; one whose header comes late is."""
    late = movie([image("a", 0)])
    at = late.index(b"LIST", 12)
    late = chunk(b"RIFF", late[8:at] + chunk(b"JUNK", b"\0" * (1 << 20)) + late[at:])
    (tmp_path / "late.avi").write_bytes(late)
    with open(tmp_path / "long.avi", "wb") as out:
        out.write(movie([image("a", k) for k in range(4)]))
        out.truncate(3 << 30)
    views = registry(spark, [("l", "late.avi", 0), ("g", "long.avi", 0)])
    rows = {r["view"]: r for r in video.headers(spark, views, str(tmp_path)).collect()}
    assert (rows["l"]["width"], rows["l"]["nb_frames"], rows["g"]["width"], rows["g"]["nb_frames"]) == ("36", "1", "36", "4")
    assert len(list(video.read_frames(open(tmp_path / "long.avi", "rb")))) == 4


def test_paths_that_only_spark_reads(spark, project, monkeypatch):
    monkeypatch.setattr(video, "openable", lambda path: False)
    views = registry(spark, VIEWS)
    assert video.frames(spark, views, project.raw_videos).count() == 18 and {r["nb_frames"] for r in video.headers(spark, views, project.raw_videos).collect()} == {"6"}


def test_broken_extraction_is_made_anew_when_asked(spark, project, tmp_path):
    views, to = registry(spark, VIEWS), f"{project.root}/metadata"
    extract.extract(spark, project, views, to)
    (tmp_path / "data/view1/frame_0002.jpg").unlink()
    assert [r["frame_count"] for r in extract.extract(spark, project, views, to).collect()] == [2, 6, 5]
    (tmp_path / "data/view2/frame_0099.jpg").write_bytes(b"stale")
    kept = {v: (tmp_path / f"data/{v}/frame_0000.jpg").stat().st_mtime_ns for v, _, _ in VIEWS}
    assert [r["frame_count"] for r in extract.extract(spark, project, views, to, complete=True).collect()] == [3, 6, 5]
    assert (tmp_path / "data/view1/frame_0002.jpg").read_bytes() == image("view1", 5) and not (tmp_path / "data/view2/frame_0099.jpg").exists()
    # only what was missing is made; a view with frames that don't belong to it is made anew
    again = {v: (tmp_path / f"data/{v}/frame_0000.jpg").stat().st_mtime_ns for v, _, _ in VIEWS}
    assert [again[v] == kept[v] for v, _, _ in VIEWS] == [True, False, True]
    # marks say that all is there: no source is read but the reference view's header
    (tmp_path / "raw_videos/view1.avi").write_bytes(b"broken")
    assert [r["frame_count"] for r in extract.extract(spark, project, views, to, complete=True).collect()] == [3, 6, 5]
    # another offset is another set of frames
    moved = registry(spark, [("view2", "view2.avi", 0), ("view3", "view3.avi", 2)])
    assert [r["frame_count"] for r in extract.extract(spark, project, moved, to, complete=True).collect()] == [6, 4]


def test_failing_forced_extraction_leaves_the_old_frames(spark, project, tmp_path):
    views, to = registry(spark, VIEWS), f"{project.root}/metadata"
    extract.extract(spark, project, views, to)
    before = {p: p.read_bytes() for p in (tmp_path / "data").rglob("*") if p.is_file()}

    def failing(file):
        yield b"\xff\xd8x\xff\xd9"
        raise ValueError("half way")

    with pytest.raises(Exception, match="half way"):
        extract.extract(spark, project, views, to, force=True, decode=failing)
    assert {p: p.read_bytes() for p in (tmp_path / "data").rglob("*") if p.is_file()} == before


def test_decoding_from_key_frame_to_key_frame(spark, tmp_path):
    """A stand-in decoder, which makes an image of each chunk, gets runs of a video, each a file of its own."""
    coded = [bytes([k]) * (50 + k) for k in range(1, 31)]
    (tmp_path / "a.avi").write_bytes(movie(coded, codec=b"XVID", index="idx1", keys={0, 10, 15, 25}))
    views = registry(spark, [("a", "a.avi", 12)])

    def decode(file):
        whole = file.read()
        assert whole[:4] == b"RIFF"
        at = whole.index(b"movi") + 4
        while at < len(whole):
            size = struct.unpack("<I", whole[at + 4 : at + 8])[0]
            if whole[at : at + 4] == b"01dc":
                yield b"\xff\xd8" + whole[at + 8 : at + 8 + size]
            at += 8 + size + size % 2

    want = [(k, b"\xff\xd8" + c) for k, c in enumerate(coded)]
    whole = video.frames(spark, views, str(tmp_path), lambda f: iter([b"\xff\xd8" + c for c in coded]))
    assert [(r.n, bytes(r.image)) for r in whole.orderBy("n").collect()] == want
    parts = video.frames(spark, views, str(tmp_path), decode, split=1, by_key=True)
    assert [(r.n, bytes(r.image)) for r in parts.orderBy("n").collect()] == want and parts.withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 3
    assert [r.n for r in video.frames(spark, views, str(tmp_path), decode, split=1, by_key=True, trimmed=True).orderBy("n").collect()] == list(range(12, 30))
    with pytest.raises(Exception, match="images of"):
        video.frames(spark, views, str(tmp_path), lambda f: iter([b"\xff\xd8"]), split=1, by_key=True).collect()


def test_extract_skip_force_and_metadata_only(spark, project, tmp_path):
    views, to = registry(spark, VIEWS), f"{project.root}/metadata"
    assert frames.list_frames(spark, project.data).count() == 0
    (tmp_path / "data" / "view2").mkdir(parents=True)  # present but empty: extracted all the same
    rows = extract.extract(spark, project, views, to).collect()
    assert [(r["view"], r["frame_count"], r["resolution"], r["time_offset_sec"]) for r in rows] == [("view1", 3, "36x28", 0.12), ("view2", 6, "36x28", 0.0), ("view3", 5, "36x28", 0.04)]
    assert (tmp_path / "data/view1/frame_0000.jpg").read_bytes() == image("view1", 3)
    # present frames are skipped, and counted as they are
    (tmp_path / "data/view1/frame_0002.jpg").unlink()
    (tmp_path / "data/view1/other.txt").write_text("x")
    (tmp_path / "raw_videos/view1.avi").unlink()
    assert [r["frame_count"] for r in extract.extract(spark, project, views, to).collect()] == [2, 6, 5]
    assert [r["frame_count"] for r in extract.extract(spark, project, views, to, metadata_only=True).collect()] == [2, 6, 5]
    with pytest.raises(FileNotFoundError):
        extract.extract(spark, project, views, to, force=True)
    # a larger offset leaves no frames of the smaller one behind
    more = registry(spark, [v for v in VIEWS if v[0] == "view2"] + [("view3", "view3.avi", 4)])
    assert [r["frame_count"] for r in extract.extract(spark, project, more, to, force=True).collect()] == [6, 2]
    assert (tmp_path / "data/view3/frame_0001.jpg").read_bytes() == image("view3", 5)


def test_programs(spark, project, tmp_path):
    """The two programs as they are called, with the registered views."""
    manifests = tmp_path / "manifests"
    extract.main(["probe", "--root", project.root, "--manifests", str(manifests)])
    extract.main(["extract", "--root", project.root, "--manifests", str(manifests)])
    extract.main(["extract", "--root", project.root, "--manifests", str(manifests), "--complete", "--metadata-only"])
    assert (manifests / "video_inspection.csv").read_text().splitlines()[1:] == [f"{v},{n},mjpeg,36,28,25/1,0.240000,6" for v, n, _ in VIEWS]
    assert [line.split(",")[5] for line in (manifests / "metadata.csv").read_text().splitlines()[1:]] == ["3", "6", "5"]
    assert len(list((tmp_path / "data").rglob("frame_*.jpg"))) == 14


def test_missing_reference_fails_before_any_manifest(spark, project, tmp_path):
    (tmp_path / "raw_videos/view2.avi").unlink()
    with pytest.raises(FileNotFoundError):
        extract.extract(spark, project, registry(spark, VIEWS), f"{project.root}/metadata", metadata_only=True)
    assert not (tmp_path / "metadata").exists()


def test_actions(spark):
    rows = [("a", 5, False), ("b", 0, False), ("c", 0, True), ("d", 5, True)]
    counts = spark.createDataFrame(rows, "view string, frame_count long, there boolean")
    plain = {r["view"]: r["action"] for r in extract.actions(counts, F.col("there")).collect()}
    forced = {r["view"]: r["action"] for r in extract.actions(counts, F.col("there"), force=True).collect()}
    assert plain == {"a": "skip", "b": "error_missing_source", "c": "extract", "d": "skip"}
    assert forced == {"a": "error_missing_source", "b": "error_missing_source", "c": "extract", "d": "extract"}


def test_frame_table_and_decoder(spark, project, tmp_path):
    views = registry(spark, VIEWS)
    kept = align.trim(video.frames(spark, views, project.raw_videos), views)
    frames.write_frame_table(kept.select("view", "frame_idx", "image"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).where("view = 'view1'").count() == 3
    joined = b"".join(picture(k) for k in range(3))
    assert list(video.external_decoder(["cat"])(io.BytesIO(joined))) == [picture(k) for k in range(3)]


def test_inspection_keeps_every_view(spark):
    views = registry(spark, VIEWS)
    parsed = manifest.parse_probe(spark.createDataFrame([("view2", "width=5")], "view string, text string"))
    rows = manifest.inspection(parsed, views).collect()
    assert [(r["view"], r["width"], r["height"]) for r in rows] == [("view1", "", ""), ("view2", "5", ""), ("view3", "", "")]
