"""Connected components of a table of links, by alternating large-star and small-star joins.

Before each round every task joins what is linked among its own rows, which leaves at most a link per node and task;
rounds are then few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, scratch, settle

#: Links that a task joins at once.
TASK_LINKS = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """Of nodes 0 to n - 1, the least node that the links (a, b) reach; root: what earlier links gave."""
    root = np.arange(n) if root is None else root
    a, b = root[a], root[b]
    while True:
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]


def _contracted(pairs: DataFrame) -> DataFrame:
    """(u, v) with u > v: links of fewer rows that join the same nodes, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            ends = [np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1)]
            nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
            root = roots(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))
            own = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])

        parts, have = [], 0
        for b in batches:
            parts.append(b)
            have += b.num_rows
            if have >= TASK_LINKS:
                yield joined(parts)
                parts, have = [], 0
        if have:
            yield joined(parts)

    return pairs.mapInArrow(run, "u long, v long")


def _star(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
    """Links of each u's larger (large) or smaller neighbours to the least of u and its neighbours."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    # a large one is a table of its own, so that its join can be dealt anew where one node has many links
    least = F.broadcast(least) if few else settle(least)
    out = both.join(least, F.col("u") == F.col("c"))
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v")


def _sum(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _fewer(links: DataFrame) -> DataFrame:
    """Contracted by task, dealt by node, which a task names once, and contracted again; settled."""
    return settle(_contracted(_contracted(links).repartition("u")).distinct())


def some_roots(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), settled, after a single round: nodes of equal roots are linked by a chain, others may be too. A node without a row is its own root."""
    now = _fewer(pairs.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v"))
    out = settle(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
    forget(now)
    return out


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), settled: the least node that links reach, for every node with a link to another.

    Nodes are numbers. Links to a node itself, nulls and repeats do not count; without
    links there are no rows. Rounds are about the logarithm of the longest path, at most.
    """
    with scratch() as keep:
        return keep(_components(pairs, a, b))


def _components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    now, before = _fewer(pairs.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")), None
    while True:
        after = _sum(now)
        if after == before or not after[0]:
            break
        before, few = after, after[0] <= BROADCAST_ROWS // 2
        large = _star(now, True, few)
        large = large if few else settle(large)
        then = _fewer(_star(large, False, few))
        forget(now)
        now = then
    out = settle(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct()))
    forget(now)
    return out
