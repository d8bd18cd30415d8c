import datetime
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lockstep.functions import text
from lockstep.operators import align, manifest
from lockstep.operators.registry import VIEWS, registry, sources

HEADERS = [(v, s, "mpeg4", "360", "288", "25/1", "156.600000", "3915") for v, s, _ in VIEWS]
GOLDEN = [
    ("view1", 25.0, 3, 0.12, "360x288", 3912, "Aligned to view2 (reference); offset +3 frames"),
    ("view2", 25.0, 0, 0.0, "360x288", 3915, "Reference view"),
    ("view3", 25.0, 1, 0.04, "360x288", 3914, "Aligned to view2 (reference); offset +1 frames"),
]


@pytest.fixture(scope="module")
def inspected(spark):
    return spark.createDataFrame(HEADERS, manifest.INSPECTION)


def test_golden_manifest_from_headers(spark, inspected):
    views = registry(spark)
    counts = align.frame_counts(align.frame_index(inspected, views), views)
    got = manifest.alignment(counts, manifest.reference_resolution(inspected, "view2"), "view2").collect()
    assert [tuple(r) for r in got] == GOLDEN
    ok = manifest.consistency(inspected, counts).collect()
    assert all(r["consistent"] and r["duration_agrees"] and r["rate_agrees"] for r in ok)


def test_golden_alignment_of_frames(spark, inspected):
    index = align.frame_index(inspected, registry(spark))
    full = align.aligned_full(index, ["view1", "view2", "view3"], "src_frame", "src")
    rows = {r["frame_idx"]: tuple(r)[1:] for r in full.collect()}
    assert len(rows) == 3915
    assert align.aligned(index, ["view1", "view2", "view3"], "src_frame", "src").count() == 3912
    assert rows[0] == (3, 0, 1) and rows[3911] == (3914, 3911, 3912)
    assert rows[3912] == (None, 3912, 3913) and rows[3913] == (None, 3913, 3914) and rows[3914] == (None, 3914, None)
    assert index.where("view = 'view1' AND frame_idx = 0").first()["file_name"] == "frame_0000.jpg"


def test_resolution_is_the_reference_views(spark):
    rows = [list(h) for h in HEADERS]
    rows[0][3] = "720"
    inspected = spark.createDataFrame([tuple(r) for r in rows], manifest.INSPECTION)
    assert manifest.reference_resolution(inspected, "view2").first()["resolution"] == "360x288"


@pytest.mark.parametrize(("nb", "offset", "count"), [("3", 5, 0), ("3", 3, 0), ("3", 0, 3), ("3", 2, 1), ("", 0, 0), ("x", 0, 0)])
def test_offsets_past_the_end(spark, nb, offset, count):
    views = registry(spark, [("a", "a.avi", offset)])
    index = align.frame_index(spark.createDataFrame([("a", nb)], "view string, nb_frames string"), views)
    assert align.frame_counts(index, views).first()["frame_count"] == count


def test_registry_rejects(spark):
    for bad in ([("a", "a.avi", -1)], [("a", "a.avi", 0), ("a", "b.avi", 1)], [("", "a.avi", 0)], [("a", "a.avi", None)]):
        with pytest.raises(ValueError):
            registry(spark, bad)
    assert [tuple(r) for r in sources(registry(spark)).collect()] == [(0, "view1", "view1.avi"), (1, "view2", "view2.avi"), (2, "view3", "view3.avi")]


def test_numbering_trimming_and_order(spark):
    frames = spark.createDataFrame([("a", t, i) for i, t in enumerate([5, 3, 3, 9])] + [("b", 1, 9), ("z", 1, 1)], "view string, ts int, id int")
    views = registry(spark, [("b", "b.avi", 0), ("a", "a.avi", 1)])
    kept = align.trim(align.number_frames(frames, ["ts", "id"]), views)
    assert sorted((r["view"], r["id"], r["n"], r["frame_idx"]) for r in kept.collect()) == [("a", 0, 2, 1), ("a", 2, 1, 0), ("a", 3, 3, 2), ("b", 9, 0, 0)]
    counts = align.frame_counts(kept.where("view <> 'b'"), views)
    rows = manifest.alignment(counts, F.lit(None).cast("string"), "b").collect()
    assert [(r["view"], r["frame_count"]) for r in rows] == [("b", 0), ("a", 3)]


@pytest.mark.parametrize("parts", [1, 3, 64, None])
def test_numbers_do_not_depend_on_the_ranges(spark, parts):
    """Ties, nulls, one value that is everywhere, and columns of several types; a null view is a view."""
    rows = [(["a", "a", "b", None][k % 4], None if k % 11 == 0 else (7 if k % 3 else k % 50), datetime.datetime(2024, 3, 31, 1, 0) + datetime.timedelta(minutes=k * 37 % 400), k) for k in range(1500)]
    frame = spark.createDataFrame(rows, "view string, a int, t timestamp_ntz, k long").repartition(5).withColumn("z", F.col("t").cast("timestamp")).withColumn("b", F.encode(F.col("view"), "utf-8"))
    for order in (["a", "t", "k"], ["z", "k"], ["b", "a", "k"]):
        want = frame.withColumn("n", (F.row_number().over(Window.partitionBy("view").orderBy(*order)) - 1).cast("long"))
        got = align.number_frames(frame, order, parts)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and got.count() == 1500


def test_a_view_is_numbered_by_several_tasks(spark):
    frame = spark.range(8000).selectExpr("'a' AS view", "id AS ts")
    numbered = align.number_frames(frame, ["ts"], 16)
    assert numbered.where("n <> ts").isEmpty()
    sizes = [r["c"] for r in frame.withColumn("p", align.ranges(frame, ["ts"], 16)).groupBy("p").agg(F.count("*").alias("c")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1000
    assert align.number_frames(frame.limit(0), ["ts"]).count() == 0


def test_counts_without_numbering(spark):
    frame = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("z",)], "view string")
    views = registry(spark, [("a", "a.avi", 3), ("b", "b.avi", 4), ("c", "c.avi", 0)])
    assert {r["view"]: r["frame_count"] for r in align.kept_counts(frame, views).collect()} == {"a": 2, "b": 0, "c": 0}


def test_plan_trims_with_a_broadcast_and_one_window(spark):
    frames = spark.range(10).selectExpr("concat('a', id % 2) AS view", "id AS ts")
    kept = align.trim(align.number_frames(frames, ["ts"]), registry(spark, [("a1", "a.avi", 2)]))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # one window over frames, by view and range; the other one is over counts
    assert plan.count("row_number() windowspecdefinition(view") == 1 and "BroadcastHashJoin" in plan and "hashpartitioning(view" in plan and "__part" in plan


def test_names(spark):
    rows = spark.range(1).select(
        text.frame_name(F.lit(7)).alias("a"), text.frame_name(F.lit(12345)).alias("b"), text.frame_number(F.lit("frame_12345.jpg")).alias("c"),
        text.frame_number(F.lit("other.jpg")).alias("d"), text.is_frame_name(F.lit("frameX1.jpg")).alias("e"), text.is_frame_name(F.lit("frame_1.jpg")).alias("f"),
        text.is_frame_name(F.lit(None).cast("string")).alias("g"),
    ).first()
    assert tuple(rows) == ("frame_0007.jpg", "frame_12345.jpg", 12345, None, False, True, False)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 4999), min_size=1, max_size=40), st.sampled_from([24.0, 25.0, 29.97, 30.0, 32.0, 50.0, 60.0]))
def test_time_offset_rounds_halves_to_even(spark, offsets, fps):
    got = spark.createDataFrame([(o,) for o in offsets], "o int").select(text.time_offset(F.col("o"), fps).alias("t")).collect()
    assert [r["t"] for r in got] == [float(Decimal(repr(o / fps)).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)) for o in offsets]


def test_time_offset_tie(spark):
    assert spark.range(1).select(text.time_offset(F.lit(1), 32.0).alias("t")).first()["t"] == 0.0312


PROBES = [
    ("codec_name=mpeg4\nwidth=360\nheight=288\nr_frame_rate=25/1\nduration=156.600000\nnb_frames=3915\n", ("mpeg4", "360", "288", "25/1", "156.600000", "3915")),
    ("\r\n codec_name=a=1=2\r\nwidth\r\nheight=1\r\nheight=2", ("a=1=2", "", "2", "", "", "")),
    ("", ("",) * 6),
    (None, ("",) * 6),
    ("xwidth=3\nwidth2=4", ("",) * 6),
]


@pytest.mark.parametrize(("probe", "fields"), PROBES)
def test_probe_text(spark, probe, fields):
    row = manifest.parse_probe(spark.createDataFrame([(probe,)], "text string")).drop("text").first()
    assert tuple(row) == fields


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["width", "height", "w", ""]), st.text("ab=1 ", max_size=4)), max_size=6))
def test_probe_text_as_by_hand(spark, pairs):
    probe = "\n".join(f"{k}={v}" for k, v in pairs)
    fields = {}
    for line in probe.strip().splitlines():
        key, _, value = line.partition("=")
        fields[key] = value
    row = manifest.parse_probe(spark.createDataFrame([(probe,)], "text string")).first()
    assert (row["width"], row["height"]) == (fields.get("width", ""), fields.get("height", ""))


def test_manifests_survive_csv(spark, tmp_path):
    rows = [("v1", 25.0, 1, 0.0004, "", 3, 'a, "b"'), ("v0", 25.0, 0, 0.0, "1x2", 0, "")]
    manifest.write_manifest(spark.createDataFrame(rows, manifest.ALIGNMENT), str(tmp_path / "m"))
    back = manifest.read_manifest(spark, str(tmp_path / "m"), manifest.ALIGNMENT)
    assert [tuple(r) for r in back.collect()] == rows
    text_ = next((tmp_path / "m").glob("part-*")).read_text().splitlines()
    assert text_[0] == "view,fps,frame_offset,time_offset_sec,resolution,frame_count,notes" and text_[1].endswith('3,"a, ""b"""')


def test_manifest_as_one_named_file(spark, tmp_path):
    rows = [("v1", 25.0, 1, 0.04, "1x2", 3, "x"), ("v0", 25.0, 0, 0.0, "1x2", 0, "")]
    frame = spark.createDataFrame(rows, manifest.ALIGNMENT)
    target = tmp_path / "metadata.csv"
    target.mkdir()  # as an earlier version left it
    for some in (frame, frame.limit(1), frame.limit(0)):
        manifest.write_manifest(some, str(target))
        assert target.is_file() and manifest.read_manifest(spark, str(target), manifest.ALIGNMENT).count() == some.count()
        assert target.read_text().splitlines()[0] == "view,fps,frame_offset,time_offset_sec,resolution,frame_count,notes"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["metadata.csv"]
