"""Registries: which views there are, where they come from, and how many leading frames each drops."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "position int, view string, source string, offset int"
#: Frames a second, the same for all views.
FPS = 25.0
#: Fixed values: (view, source, offset); the view with offset 0 is the reference.
VIEWS = (("view1", "view1.avi", 3), ("view2", "view2.avi", 0), ("view3", "view3.avi", 1))
REFERENCE = "view2"


def registry(spark: SparkSession, views: Iterable[tuple[str, str, int]] = VIEWS) -> DataFrame:
    """(position, view, source, offset) in the given order; rejects negative offsets and repeated or missing names."""
    rows = [(k, *v) for k, v in enumerate(views)]
    names = [r[1] for r in rows]
    if any(not n for n in names) or len(set(names)) < len(names):
        raise ValueError("views need names of their own")
    if any(r[3] is None or r[3] < 0 for r in rows):
        raise ValueError("offsets are 0 or more")
    return spark.createDataFrame(rows, SCHEMA)


def sources(views: DataFrame) -> DataFrame:
    """(position, view, filename) of a registry."""
    return views.selectExpr("position", "view", "source AS filename")
