"""Mixing sources to target weights.

Tokens (words) are summed per source, targets and repetition rates follow from the
sums, and each document is taken floor(rate) times plus one hash-seeded Bernoulli copy
whose probability is the fraction of the rate. Built-in functions only: one aggregation with map-side
sums, then a map-only pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.align import ranges
from .common import WORD_PATTERN, scratch, settle

#: Weights of the sources by rank, repeating; and the most a source gives, as a multiple of its size.
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: A source table of this many rows and name bytes at most is ranked by one task and broadcast; a larger one is dealt by ranges, and joined by shuffling.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 4 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _before(table: DataFrame, order: list[str], sums: dict[str, str], parts: int) -> DataFrame:
    """table with a sum of a column over all earlier rows for each entry of sums, new name to column.

    Rows are dealt by ranges of the order; each range adds up its own, from what the ranges before it hold in all.
    """
    placed = table.withColumn("__part", ranges(table, order, parts))
    # a row per range
    totals = placed.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__part").alias("__own"), *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__s_{k}") for k in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"__l_{k}": F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()})
    both = own.join(F.broadcast(starts), F.col("__part") == F.col("__own"))
    return both.select(*table.columns, *[(F.col(f"__s_{k}") + F.col(f"__l_{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, parts: int = 1) -> DataFrame:
    """(__source, __source_size) to the same and __target, exact up to one division.

    In the order of size / weight, a source stops at its cap as long as its share of what the
    sources before it leave is above the cap; the others share the rest by weight. That is
    where resharing the excess again and again ends. parts: ranges that the sources are ranked and added up in; the result is the same for any.
    """
    common = math.lcm(*weights)
    exact = lambda c: c.cast("decimal(38,0)")
    named = sizes.withColumns({"__last": F.col("__source").isNull(), "__one": F.lit(1)})
    ranked = _before(named, ["__last", "__source"], {"__rank": "__one"}, parts)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    out = ranked.withColumn("__w", weight.cast("long"))
    out = out.withColumn("__steep", exact(F.col("__source_size")) * F.expr(f"{common} div __w"))
    if parts > 1:  # many sources: their ranks are not made again for each use
        out = settle(out)
    out = settle(_before(out, ["__steep", "__last", "__source"], {"__size_before": "__source_size", "__w_before": "__w"}, parts))
    # sums over all sources are one row
    out = out.crossJoin(F.broadcast(out.agg(F.sum("__source_size").alias("__all"), F.sum("__w").alias("__w_all"))))
    left = exact(F.col("__all") - F.col("__size_before") * cap)
    full = left * F.col("__w") > exact(F.col("__source_size")) * F.lit(cap) * (F.col("__w_all") - F.col("__w_before"))
    out = out.withColumn("__full", full)
    free = out.agg(F.sum(F.when(F.col("__full"), F.col("__source_size"))).alias("__size_full"), F.sum(F.when(~F.col("__full"), F.col("__w"))).alias("__w_free"))
    out = out.crossJoin(F.broadcast(free))
    rest = F.col("__all") - cap * F.coalesce("__size_full", F.lit(0))
    target = F.when(F.col("__full"), (cap * F.col("__source_size")).cast("double")).otherwise((F.col("__w") * rest).cast("double") / F.col("__w_free").cast("double"))
    return out.withColumn("__target", target).select("__source", "__source_size", "__target")


def draw(key: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key's value and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan(docs: DataFrame, seed: str = SEED, by_text: bool = False) -> DataFrame:
    """(doc, size, source_size, target, copies, taken): each row of docs as a struct, and what the mix takes of it.

    Null text has size 0; a null source is a source of its own, ranked last. Rows that share a doc_id
    share their draw, null ones too as the SQL has it; by_text, rows with a null doc_id share it only where their texts are
    equal. If no document has a word, targets and copies are 0. An empty table stays empty.
    Whatever columns docs has stay in the struct.
    """
    sized = docs.select(F.struct(*docs.columns).alias("doc"), words(F.col("text")).alias("size"), F.col("source").alias("__source"))
    with scratch() as keep:
        sizes = settle(sized.groupBy("__source").agg(F.sum("size").alias("__source_size")))
        rows, names = sizes.agg(F.count("*"), F.coalesce(F.sum(F.length("__source")), F.lit(0))).first()
        few = rows <= BROADCAST_ROWS and names * 4 <= BROADCAST_BYTES
        parts = 1 if few else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # settled, so that the few rows are made once, and that a join of many is one of two plain shuffles
        targets = keep(settle(source_targets(sizes, parts=parts).withColumnRenamed("__source", "__name")))
    if few:
        targets = F.broadcast(targets)
    out = sized.join(targets, F.col("__source").eqNullSafe(F.col("__name")))
    rate = F.when(F.col("__source_size") > 0, F.least(F.col("__target") / F.col("__source_size"), F.lit(float(CAP)))).otherwise(0.0)
    out = out.withColumn("rate", rate)
    if by_text:
        name = F.concat(F.lit("text:"), F.xxhash64("doc.text").cast("string"), F.lit(":"), F.xxhash64(F.lit(1), "doc.text").cast("string"))
        out = out.withColumn("__draw_key", F.coalesce(F.col("doc.doc_id").cast("string"), name))
    copies = F.floor("rate") + (draw("__draw_key" if by_text else "doc.doc_id", seed) < F.col("rate") - F.floor("rate")).cast("long")
    out = out.select("doc", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, seed: str = SEED, by_text: bool = False) -> DataFrame:
    """The mixed corpus: every row as often as its copies say, with the columns of docs."""
    copies = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    return plan(docs, seed, by_text).select("doc", F.explode(copies)).select("doc.*")


def taken(docs: DataFrame) -> DataFrame:
    return plan(docs.select("doc_id", "text", "source")).select("doc.doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM sources),
steep AS (SELECT *, CAST(source_size AS HUGEINT) * (10 // w) AS steep FROM ranked),
sums AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY steep, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS before,
    sum(w) OVER (ORDER BY steep, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM steep),
capped AS (SELECT *, (total - before) * w > source_size * 3 * weight_left AS full_ FROM sums),
targets AS (
  SELECT source, source_size, CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(w * (total - 3 * coalesce(sum(CASE WHEN full_ THEN source_size END) OVER (), 0)) AS DOUBLE)
       / CAST(sum(CASE WHEN NOT full_ THEN w END) OVER () AS DOUBLE) END AS target
  FROM capped),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rated
"""
