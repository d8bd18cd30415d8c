import random

import pytest

from lockstep.functions.text import frame_number
from lockstep.operators import presence
from lockstep.sources import frames
from pyspark.sql import functions as F


def plain_gaps(own, until):
    out, k = [], 0
    while k < until:
        if k in own:
            k += 1
            continue
        first = k
        while k < until and k not in own:
            k += 1
        out.append((first, k - 1))
    return out


@pytest.fixture(scope="module")
def numbers():
    rng = random.Random(2)
    out = {"a": set(range(100)), "b": set(rng.sample(range(300), 200)), "c": {0, 32_767, 32_768, 65_535, 65_536, 99_999}, "d": set(range(30_000, 70_000)) - {40_000}, "e": {7}}
    return out


def test_runs_gaps_and_counts(spark, numbers):
    rows = [(v, k) for v, own in numbers.items() for k in own]
    frame = spark.createDataFrame([*rows, *rows[:50], ("a", None), ("a", -1), (None, 3)], "view string, frame_idx long").repartition(5)
    index = presence.presence(frame)
    assert {r["view"]: r["frame_count"] for r in presence.counts(index).collect()} == {v: len(own) for v, own in numbers.items()}
    got = sorted(map(tuple, presence.runs(index).collect()))
    assert got == sorted((v, a, b) for v, own in numbers.items() for a, b in _runs(own))
    for until in (0, 1, 90, 33_000, 100_000):
        expected = spark.createDataFrame([(v, until) for v in [*numbers, "none"]], "view string, frame_count long")
        want = sorted((v, a, b) for v in [*numbers, "none"] for a, b in plain_gaps(numbers.get(v, set()), until))
        assert sorted(map(tuple, presence.gaps(index, expected).collect())) == want
    assert presence.runs(index.limit(0)).count() == 0 == presence.counts(index.limit(0)).count()


def _runs(own):
    out = []
    for k in sorted(own):
        if out and out[-1][1] == k - 1:
            out[-1][1] = k
        else:
            out.append([k, k])
    return [tuple(r) for r in out]


def test_indexes_merge(spark, numbers):
    rows = [(v, k) for v, own in numbers.items() for k in own]
    part = lambda some: presence.presence(spark.createDataFrame(some, "view string, frame_idx long"))
    both = presence.merged(part(rows[::2]), part(rows[1::3]), part(rows[1::2]))
    assert sorted((r.view, r.row, bytes(r.bits)) for r in both.collect()) == sorted((r.view, r.row, bytes(r.bits)) for r in part(rows).collect())


def test_missing_rows(spark, numbers):
    index = presence.presence(spark.createDataFrame([(v, k) for v, own in numbers.items() for k in own], "view string, frame_idx long"))
    wanted = spark.createDataFrame([(v, k, "x") for v in ("b", "c", "none") for k in (*range(320), 32_767, 32_768, 40_000, 99_999)], "view string, frame_idx long, note string")
    got = presence.missing(wanted, index)
    assert got.columns == wanted.columns
    assert sorted((r.view, r.frame_idx) for r in got.collect()) == sorted((v, k) for v in ("b", "c", "none") for k in (*range(320), 32_767, 32_768, 40_000, 99_999) if k not in numbers.get(v, ()))


def test_names_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    for view, n in (("a", 25), ("b", 3)):
        (tmp_path / "data" / view).mkdir(parents=True)
        for k in range(n):
            (tmp_path / "data" / view / f"frame_{k:04d}.jpg").write_bytes(b"x" * k)
    (tmp_path / "data/b/other.jpg").write_bytes(b"")
    (tmp_path / "data/.new-1/a").mkdir(parents=True)
    (tmp_path / "data/.new-1/a/frame_0000.jpg").write_bytes(b"")
    (tmp_path / "data/c").mkdir()
    monkeypatch.setattr(frames, "NAMES", 10)
    listed = frames.list_frames(spark, str(tmp_path / "data"))
    assert "FileScan" not in listed._jdf.queryExecution().executedPlan().toString() and listed.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, listed.collect())) == sorted((v, f"frame_{k:04d}.jpg", k) for v, n in (("a", 25), ("b", 3)) for k in range(n))
    monkeypatch.setattr(frames, "openable", lambda path: False)
    assert sorted(map(tuple, frames.list_frames(spark, str(tmp_path / "data")).where("view in ('a', 'b')").collect()))[:2] == [("a", "frame_0001.jpg", 1), ("a", "frame_0002.jpg", 2)]
    numbered = listed.withColumn("frame_idx", frame_number(F.col("file_name")))
    assert presence.gaps(presence.presence(numbered), spark.createDataFrame([("b", 5)], "view string, frame_count long")).collect()[0][1:] == (3, 4)
