import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lockstep.llm import common, queries
from lockstep.llm.common import forget, settle, shared_dir, slices, text_bytes


def test_every_operator_has_its_query():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.ORACLES) <= set(names) and set(names) | {"pipeline"} <= set(entry.queries())
    assert {"op2_pii", "op6_line_dedup", "op10_mixing"} <= set(entry.oracle_sql())


class Session:
    """A session's settings only."""

    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_shared_folder():
    own = Session(spark_checkpoint_dir="hdfs://a/b/", spark_sql_warehouse_dir="/w")
    assert shared_dir(own).startswith("hdfs://a/b/") and shared_dir(own) != shared_dir(own)
    assert shared_dir(Session(spark_sql_warehouse_dir="/w/", spark_master="local[4]")).startswith("/w/_checkpoints/")
    for master in ("yarn", "spark://a:7077"):
        with pytest.raises(ValueError):
            shared_dir(Session(spark_sql_warehouse_dir="/w/", spark_master=master))


def test_settled_tables_and_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    frame = spark.range(10).repartition(3).selectExpr("id AS k", "id % 3 AS r")
    kept = settle(frame)
    assert sorted(r["k"] for r in kept.collect()) == list(range(10)) and kept.dtypes == frame.dtypes and spark.conf.get(key) == before
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    assert os.path.isdir(folder)
    forget(kept)
    assert not os.path.exists(folder)


def _tables(spark):
    base = shared_dir(spark).rpartition("/")[0].removeprefix("file:")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_scratch_leaves_what_is_kept(spark):
    before = _tables(spark)
    with common.scratch() as keep:
        one = keep(settle(spark.range(3)))
        with common.scratch() as inner:
            settle(spark.range(4))
            two, three = inner(settle(spark.range(5))), inner(settle(spark.range(6)))
        assert two.count() == 5 and len(_tables(spark) - before) == 3
        forget(three)
    assert one.count() == 3 and len(_tables(spark) - before) == 1
    with pytest.raises(ValueError), common.scratch():
        settle(spark.range(3))
        raise ValueError
    forget(one)
    assert _tables(spark) == before


def test_operators_leave_only_what_their_results_read(spark, docs, monkeypatch):
    from lockstep.llm import collocations, components, divergence, jaccard_join, mixing, suffix_dedup

    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    monkeypatch.setattr(components, "BROADCAST_ROWS", 4)  # rounds settle what they would else broadcast
    for run, most in (
        (lambda: components.components(pairs), 1), (lambda: jaccard_join.components_of(docs), 2), (lambda: mixing.taken(docs), 1), (lambda: suffix_dedup.dedup(docs), 2),
        (lambda: divergence.audit(docs), 3), (lambda: collocations.mine(docs, least=3), 6),
    ):
        before = _tables(spark)
        found = run()
        assert len(_tables(spark) - before) <= most
        found.count()


def test_pipeline_leaves_the_last_stage_only(spark):
    before = _tables(spark)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert len(_tables(spark) - before) == 1


def test_settings_of_several_writers(spark):
    """The session's own settings come back when the last writer is done, in whatever order they end."""
    before = {k: spark.conf.get(k, None) for k in common.SETTINGS}
    one, two = common._written(spark), common._written(spark)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert all(spark.conf.get(k) == v for k, v in common.SETTINGS.items())
    two.__exit__(None, None, None)
    assert {k: spark.conf.get(k, None) for k in common.SETTINGS} == before


def test_small_tables_are_broadcast(spark, monkeypatch):
    table = settle(spark.range(5).toDF("k"))
    plan = lambda: spark.range(10).toDF("x").join(common.looked_up(table), F.col("x") == F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 4)
    assert "broadcast" not in plan()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary(), pa.large_binary()])
def test_slices_and_bytes(kind):
    values = [None, b"abc", b"", b"x" * 50, "é".encode(), None, b"z"]
    column = pa.array([None if v is None else v if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else v.decode() for v in values], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), column], ["k", "text"]).slice(1)
    parts = list(slices(iter([batch]), limit=8))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(1, 7)) and len(parts) > 2
    got = []
    for p in parts:
        data, bounds = text_bytes(p.column(1))
        got += [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
    assert got == [v or b"" for v in values[1:]]
    assert not list(slices(iter([batch.slice(0, 0)])))
    assert isinstance(text_bytes(pa.array([], kind))[1], np.ndarray)


def test_buckets_grow_with_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([("éé",), (None,), ("abcdef",)], "text string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.buckets_for(docs) == least == common.buckets_for(docs.limit(0))
    monkeypatch.setattr(common, "BUCKET_BYTES", 1)
    assert common.buckets_for(docs) == 10
