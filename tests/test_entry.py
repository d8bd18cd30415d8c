import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lockstep.operators.registry import registry
from lockstep.plans import alignment_queries
from lockstep.streaming.frames import count_stream, trim_stream

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(frame):
    return sorted(map(repr, frame))


@needs_data
@pytest.mark.parametrize("name", alignment_queries.QUERIES)
def test_queries_equal_their_sql(spark, name):
    with duckdb.connect() as db:
        for table in ("events", "part", "conversations", "orders"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        found = db.execute(alignment_queries.ORACLES[name])
        columns = [d[0] for d in found.description]
        want = found.fetchall()
    got = alignment_queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(alignment_queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_llm_subpackage():
    home = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(home, "lockstep")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, name)).read()


def test_only_a_missing_subpackage_is_passed_over(tmp_path):
    home = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(home, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests"))
    names = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda: subprocess.run([sys.executable, "-c", names], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(alignment_queries.QUERIES)), str(len(alignment_queries.ORACLES))]
    (tmp_path / "copy/corpus_pipeline.py").write_text("import some_package_that_is_not_there")
    assert "some_package" in run().stderr


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", k) for k in range(5)] + [("b", 0), ("z", 0)], "view string, n long").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("view string, n long").parquet(str(tmp_path / "in"))
    kept = trim_stream(stream, registry(spark, [("a", "a.avi", 2), ("b", "b.avi", 0)]))
    query = count_stream(kept).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert {r["view"]: r["frame_count"] for r in spark.table("counts").collect()} == {"a": 3, "b": 1}
