"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt to blocks of bounded size. A block holds a forest: per tree, the long hash string of every
vector, one bit for each side of a random hyperplane, in a sorted array. A query descends each tree to its longest
matching prefix, then ascends all trees together, one bit at a time; at each depth, the rows that share that
prefix in any tree are its further candidates.

It stops where no more are needed: a vector at the angle of the query's present k-th best, or nearer, would have been met
at this depth already but with probability MISS. That probability follows from the angle, the depth and the number of
trees, so it needs no tuning by data, and what ends up at depth 0 has been compared with the whole block. A task takes one block and one run of
queries; candidates never become rows, only each query's best of each block do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

K, EVERY = 5, 50
#: Trees, bits of a hash string, and the probability that a vector as near as the k-th best is missed.
TREES, BITS, MISS = 64, 32, 0.02
#: Rows of a block and queries of a run at most, on average; bytes of a block's vectors as doubles.
BLOCK, QUERIES, BLOCK_BYTES = 65_536, 8192, 48 << 20
#: Scores that differ by less than this are computed again, one by one, before they are ranked.
CLOSE = 1e-9
FOUND = "query_id long, vec_id long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest part first: squares of very large or small numbers leave the doubles' range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of q with each row of x, summed part by part in order, so that equal rows score the same anywhere."""
    x, q = x / np.abs(x).max(axis=1, keepdims=True), q / np.abs(q).max()
    total = lambda products: np.add.accumulate(products, axis=1)[:, -1]
    return total(x * q) / (np.sqrt(total(x * x)) * np.sqrt(total((q * q)[None])))


class Forest:
    """Sorted arrays of hash strings, one per tree, over the vectors of a block."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(trees, unit.shape[1], BITS))
        self.keys, self.rows = [], []
        for key in self.strings(unit):
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.rows.append(order)

    def strings(self, unit: np.ndarray) -> list[np.ndarray]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return [(unit @ plane >= 0) @ weights for plane in self.planes]

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) bounds of the rows that share a prefix of this depth with each query."""
        low = strings >> (BITS - depth) << (BITS - depth)
        high = low + (1 << (BITS - depth))
        pairs = [(np.searchsorted(key, a), np.searchsorted(key, b)) for key, a, b in zip(self.keys, low, high)]
        return np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs])


def missed(cosine: float, depth: int, trees: int) -> float:
    """Probability that a vector of this cosine shares no prefix of this depth with the query in any tree."""
    same = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return (1 - same**depth) ** trees


def nearest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K, trees: int = TREES, miss: float = MISS) -> tuple[list[int], list[int], list[float], int]:
    """Of one block: query, row and score of each query's k best, and how many rows were compared."""
    unit, wanted = _unit(x), _unit(queries)
    forest = Forest(unit, trees)
    repeated = len(np.unique(ids)) < len(ids)

    def kth(rows: np.ndarray, scores: np.ndarray) -> float | None:
        """The k-th best score, an id counted once; None if there are fewer."""
        if repeated:
            order = np.lexsort((-scores, ids[rows]))
            scores = scores[order][np.diff(ids[rows][order], prepend=ids[rows][order][:1] - 1) != 0]
        return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None

    strings = np.stack(forest.strings(wanted))
    n, compared = len(x), 0
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in wanted]
    seen = np.zeros((len(wanted), (n + 7) // 8), np.uint8)
    active = np.arange(len(wanted))
    for depth in range(BITS, -1, -1):
        if not len(active):
            break
        first, last = forest.ranges(strings[:, active], depth)
        going = []
        for at, q in enumerate(active):
            some = np.flatnonzero(first[:, at] < last[:, at])
            if len(some):
                old = np.unpackbits(seen[q], count=n).view(bool)
                here = np.zeros(n, bool)
                for t in some:
                    here[forest.rows[t][first[t, at] : last[t, at]]] = True
                new = np.flatnonzero(here & ~old & (ids != query_ids[q]))
                seen[q] = np.packbits(here | old)
                compared += len(new)
                rows, scores = np.concatenate([best[q][0], new]), np.concatenate([best[q][1], unit[new] @ wanted[q]])
                if (least := kth(rows, scores)) is not None:
                    keep = scores >= least - CLOSE
                    rows, scores = rows[keep], scores[keep]
                best[q] = rows, scores
            if depth and ((least := kth(*best[q])) is None or missed(least, depth, trees) > miss):
                going.append(q)
        active = np.array(going, np.int64)
    out: tuple[list, list, list] = ([], [], [])
    for q, (rows, _) in enumerate(best):
        exact = cosines(x[rows], queries[q]) if len(rows) else np.zeros(0)
        named: set[int] = set()
        for r in np.lexsort((ids[rows], -exact)):
            if ids[rows[r]] not in named and len(named) < k:
                named.add(ids[rows[r]])
                for column, value in zip(out, (query_ids[q], ids[rows[r]], exact[r])):
                    column.append(value)
    return *out, compared


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are equal in id and vector, once."""
    whole = np.ascontiguousarray(np.concatenate([ids[:, None].view(np.uint8).reshape(len(ids), -1), x.view(np.uint8).reshape(len(x), -1)], axis=1))
    first = np.sort(np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True)[1])
    return ids[first], x[first]


def _fine(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(whole, F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, miss: float = MISS, block: int = BLOCK, run: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors (both vec_id, embedding), its own vec_id left out.

    Nearness is the cosine in double precision, ties go to the smaller vec_id, and a vec_id is named once, with its best score. Rows without a
    vec_id, vectors that are null, empty or zero or hold a null or non-finite part take no part, and vectors of another length are no candidates. Of
    queries that share a vec_id the least vector counts. A query without candidates has no row; empty tables give none. Other columns are ignored.
    """
    fine = lambda df: df.where(F.col("vec_id").isNotNull() & _fine(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = settle(fine(queries).groupBy("id").agg(F.min("vector").alias("vector")))
    sizes = fine(vectors).agg(F.count("*"), F.max(F.size("vector"))).first()
    rows = max(1, min(block, BLOCK_BYTES // (8 * max(sizes[1] or 1, 1))))
    blocks, runs = max(1, -(-sizes[0] // rows)), max(1, -(-asked.count() // run))
    dealt = lambda hashed, n: F.pmod(hashed, F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # by id and place, so that an id that many rows share fills no block
    held = fine(vectors).withColumn("i", dealt(F.xxhash64("id", F.monotonically_increasing_id()), blocks)).withColumn("j", every(runs)).withColumn("asks", F.lit(False))
    asking = asked.withColumn("j", dealt(F.xxhash64("id"), runs)).withColumn("i", every(blocks)).withColumn("asks", F.lit(True))
    both = held.unionByName(asking).withColumn("dim", F.size("vector"))

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        dim, asks = key[2].as_py(), table["asks"].combine_chunks()
        x, q = table.filter(pa.compute.invert(asks)), table.filter(asks)
        if not len(x) or not len(q):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, given = _once(x["id"].to_numpy(), _vectors(x["vector"], dim))
        found = nearest(given, ids, _vectors(q["vector"], dim), q["id"].to_numpy(), k, trees, miss)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = both.groupBy("i", "j", "dim").applyInArrow(compared, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated(vectors: DataFrame) -> DataFrame:
    """The contract's queries, rows whose vec_id is divisible by EVERY, against all rows."""
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


#: Every row is compared with every query: for small tables, where the forest finds all. Sums run in order, as in the operator.
ORACLE = f"""
WITH vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS raw FROM embeddings
  WHERE vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
scaled AS (SELECT vec_id, list_transform(raw, lambda x: x / list_max(list_transform(raw, lambda y: abs(y)))) AS e FROM vectors),
normed AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM scaled),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(v.e, q.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (v.norm * q.norm) AS score
  FROM normed q JOIN normed v ON q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {K}
"""
