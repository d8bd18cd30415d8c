"""Packed frames, and views in buckets."""

from lockstep.operators import align
from lockstep.sources import shards
from movies import image


def test_packed_frames_are_read_by_range(spark, tmp_path):
    rows = [(v, k, image(v, k) * (k + 1)) for v in "ab" for k in range(40)]
    frame = spark.createDataFrame([*rows, ("b", 40, None)], "view string, frame_idx long, image binary").repartitionByRange(3, "view", "frame_idx")
    shards.write_shards(frame, str(tmp_path / "packed"), shard=2000)
    index = shards.shard_index(spark, str(tmp_path / "packed"))
    files = list((tmp_path / "packed/data").iterdir())
    assert len(files) > 6 and sum(f.stat().st_size for f in files) == sum(len(r[2]) for r in rows)
    got = {(r.view, r.frame_idx): bytes(r.image) for r in shards.read_shards(index, str(tmp_path / "packed")).collect()}
    assert got == {(v, k): i for v, k, i in rows} | {("b", 40): b""}
    wanted = spark.createDataFrame([("a", 7), ("b", 7), ("b", 39), ("a", 7), ("c", 1), ("a", None)], "view string, frame_idx long")
    found = shards.frames_at(spark, str(tmp_path / "packed"), wanted)
    assert sorted((r.view, r.frame_idx, bytes(r.image)) for r in found.collect()) == [("a", 7, image("a", 7) * 8), ("b", 7, image("b", 7) * 8), ("b", 39, image("b", 39) * 40)]
    plan = index.where("view = 'a' AND frame_idx = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(view" in plan and "EqualTo(frame_idx,3)" in plan
    # shards that no row names, such as a lost task's, are no frames; writing again replaces the table
    (tmp_path / "packed/data/lost.bin").write_bytes(b"x" * 100)
    shards.write_shards(frame.where("view = 'a'"), str(tmp_path / "packed"))
    assert shards.shard_index(spark, str(tmp_path / "packed")).count() == 40


def test_views_in_buckets_are_aligned_without_a_shuffle(spark):
    views = ("x", "y", "z")
    rows = [(v, k, f"{v}{k}") for v, n in zip(views, (50, 60, 40)) for k in range(n)]
    kept = spark.createDataFrame(rows, "view string, frame_idx long, id string")
    table = align.write_by_frame(kept, "frames_by_index", 4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined, full = align.aligned_by_frame(table, views, "id", "id"), align.aligned_full(table, views, "id", "id")
        for frame in (joined, full):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, align.aligned(kept, views, "id", "id").collect()))
        assert sorted(map(str, full.collect())) == sorted(map(str, align.aligned_full(kept, views, "id", "id").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.sql("DROP TABLE frames_by_index")
