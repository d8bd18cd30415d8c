"""Line dedup by overlapping three-line windows, with built-in functions only.

Every run of WINDOW consecutive lines is named by a 128-bit hash. Names that occur more than once keep
their first occurrence, by doc_id, then a 128-bit hash of the text, then position; every later one marks its lines, marks are
merged, and marked lines go. Only names and positions are shuffled to find repeats. For the first occurrences, sums are made
before the shuffle, so that a name that is everywhere is one row per task; the join that finds the later ones is split there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

WINDOW = 3


def text_hash(text: str) -> list[Column]:
    """128 bits that stand for a text, as th and tg: rows with a null or repeated doc_id are told apart by them."""
    return [F.xxhash64(text).alias("th"), F.xxhash64(F.lit(WINDOW), text).alias("tg")]


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, tg, at): by doc_id and text, the ascending line numbers (from 0) where a window begins that occurred before."""
    lines = docs.select("doc_id", *text_hash("text"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")).where(F.size("lines") >= window)
    parts = ", ".join(f"lines[i + {k}]" for k in range(window))
    name = F.expr(f"transform(sequence(0, size(lines) - {window}), i -> struct(xxhash64({parts}) AS h, xxhash64({window}, {parts}) AS g))")
    windows = settle(lines.select("doc_id", "th", "tg", F.posexplode(name).alias("at", "w")).select("doc_id", "th", "tg", "at", "w.h", "w.g"))
    # a null doc_id comes after all others
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "tg", "at")
    firsts = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    # a table of its own: a plain join of two shuffles, of which adaptive execution splits those of a window that is everywhere
    firsts = settle(firsts.select("h", "g", "first"))
    # merged at every size: a broadcast below some size only would make disk and time jump there
    later = windows.join(firsts.hint("merge"), ["h", "g"]).where(place != F.col("first"))
    out = settle(later.groupBy("doc_id", "th", "tg").agg(F.array_sort(F.collect_set("at")).alias("at")))
    forget(windows, firsts)
    return out


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, text, n_lines, n_removed): each row of docs as a struct, and its text without the lines that go.

    A line goes if a later occurrence of a window covers it. Lines end at newlines; blank lines are lines. Texts
    of fewer lines than a window stay as they are, null texts null with 0 lines. Rows equal in
    doc_id (nulls too) and text count as one document seen twice: what is first in one is first in the other, and
    both lose the same lines. Different texts under a null or repeated doc_id are documents of their own. An empty table stays empty; whatever columns docs has stay in the struct.
    """
    marks = later_windows(docs, window).select(F.col("doc_id").alias("id"), F.col("th").alias("id_th"), F.col("tg").alias("id_tg"), "at")
    own = docs.select(F.struct(*docs.columns).alias("doc"), *text_hash("text"))
    out = own.join(marks.hint("merge"), F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("id_th")) & (F.col("tg") == F.col("id_tg")), "left")
    out = out.withColumn("split", F.split("doc.text", "\n", -1))
    # a window covers the lines from where it begins; numbers are taken away by hash, in time linear in the lines
    left = F.expr(f"array_except(sequence(0, size(split) - 1), flatten(transform(at, p -> sequence(p, p + {window - 1}))))")
    out = out.withColumn("left", F.when(F.col("at").isNotNull(), left))
    out = out.withColumn("kept", F.when(F.col("at").isNull(), F.col("split")).otherwise(F.expr("transform(left, i -> split[i])")))
    text = F.when(F.col("at").isNull(), F.col("doc.text")).otherwise(F.array_join("kept", "\n"))
    return out.select(
        "doc", text.alias("text"), F.when(F.col("doc.text").isNull(), 0).otherwise(F.size("split")).cast("long").alias("n_lines"),
        F.when(F.col("at").isNull(), 0).otherwise(F.size("split") - F.size("kept")).cast("long").alias("n_removed"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left."""
    return dedup(docs.select("doc_id", "text")).select("doc.doc_id", "n_lines", "n_removed", "text")


ORACLE = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM split WHERE len(lines) >= 3)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn FROM windows),
covered AS (
  SELECT DISTINCT doc_id, pos + k AS line FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS k FROM ranked WHERE rn > 1)),
marks AS (SELECT doc_id, list(line) AS gone FROM covered GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(len(s.lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(m.gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN m.gone IS NULL THEN s.text ELSE coalesce(array_to_string(
    list_transform(list_filter(range(1, len(s.lines) + 1), lambda i: NOT list_contains(m.gone, i - 1)), lambda i: s.lines[i]), chr(10)), '') END AS text
FROM split s LEFT JOIN marks m ON s.doc_id = m.doc_id
"""
