"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Each tree splits the vectors again and again at the median of a random projection; vectors close to a split
go to both sides. Vectors that share a leaf of a tree are compared, links verified by cosine in
double precision, and linked vectors joined by union. No pair leaves its leaf's task, and none is kept: a task sums links
per vector block by block, counting a pair in the first leaf that both share, and emits one link per vector to its
group in the leaf.

The splits are fitted on SAMPLE vectors at most, taken by a hash of the id; every vector is
indexed. Equal vectors of a label enter once, with their number. A label's leaf of more than GROUP vectors, or GROUP_BYTES of them, is
cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle
from .components import components, roots

COSINE = 0.98
TREES = 6
#: Vectors a leaf should hold, spill and all labels included; sample size; sample vectors that a leaf needs.
LEAF, SAMPLE, LEAST = 4096, 65_536, 16
#: Half the width of the overlap, as a multiple of a linked pair's usual distance along a random direction.
SPILL = 0.6
ROWS = "label int, dim int, code int, id long, copies long, vector binary, codes binary"
#: Products of vectors that a task holds at once, and linked pairs.
PRODUCTS, PAIRS = 1 << 22, 1 << 18
#: Vectors of a leaf and label that one task compares, and bytes of them as doubles; bytes of the sample.
GROUP, GROUP_BYTES, SAMPLE_BYTES = 20_000, 32 << 20, 128 << 20
#: Bits of a leaf's number below those of its tree.
NODE = 20


class Forest:
    """Directions by tree and level, thresholds by tree and node; leaves are numbered by the path to them."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, cosine: float, seed: int = 17):
        self.depth, dim = depth, sample.shape[1] if sample.ndim == 2 else 0
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(trees, max(depth, 1), dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True) if dim else 1
        self.margin = SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(max(dim, 1))
        self.cuts = np.zeros((trees, 1 << depth))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                along = sample @ self.directions[t, level]
                order = np.lexsort((along, node))
                first = np.searchsorted(node[order], np.arange((1 << level) + 1))
                for k in range(1 << level):
                    own = along[order[first[k] : first[k + 1]]]
                    self.cuts[t, (1 << level) - 1 + k] = own[len(own) // 2] if len(own) else 0.0
                node = 2 * node + (along >= self.cuts[t, (1 << level) - 1 + node])

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of every leaf that a vector falls into."""
        rows, codes = [], []
        for t in range(len(self.cuts)):
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for level in range(self.depth):
                off = (unit @ self.directions[t, level])[row] - self.cuts[t, (1 << level) - 1 + node]
                low, high = off < self.margin, off >= -self.margin
                row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
            rows.append(row)
            codes.append((t << NODE | node).astype(np.int32))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def _numbers(raw: list[bytes], dim: int) -> np.ndarray:
    """(n, dim) of vectors sent as they came, in single or double precision."""
    return np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * dim else np.float64).reshape(len(raw), dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest part first: squares of very large or small numbers leave the doubles' range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shared_before(lists: list[np.ndarray], code: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern of each row, table): whether rows of two patterns share a leaf before this one is in the table, by pairs asked for.

    Rows with the same earlier leaves are one pattern; the table has the patterns' leaves, -1 where there are none.
    """
    own = [c[c < code].tobytes() for c in lists]
    number = {c: k for k, c in enumerate(dict.fromkeys(own))}
    table = np.full((len(number), max(1, max(len(c) // 4 for c in number))), -1, np.int32)
    for c, k in number.items():
        table[k, : len(c) // 4] = np.frombuffer(c, np.int32)
    return np.array([number[c] for c in own]), table


def _leaf(key: tuple, table: pa.Table, cosine: float = COSINE) -> pa.Table:
    """Within a leaf, or between two blocks of it: kind 0, (a: id, n: linked vectors first met here); kind 1, (a: id, b: least id of its group)."""
    code, n, dim = key[2].as_py(), len(table), key[1].as_py()
    order = np.argsort(table["id"].to_numpy())
    table = table.take(pa.array(order))
    ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
    x = _unit(_numbers(table["vector"].to_pylist(), dim))
    pattern, leaves = shared_before([np.frombuffer(c, np.int32) for c in table["codes"].to_pylist()], code)
    block = table["block"].to_numpy()
    across = key[3].as_py() != key[4].as_py()
    links, root = np.zeros(n, np.int64), np.arange(n)
    step = max(1, PRODUCTS // n)
    for at in range(0, n, step):
        near = x[at : at + step] @ x[at:].T >= cosine
        near &= np.arange(near.shape[1]) > np.arange(near.shape[0])[:, None]
        if across:
            near &= block[at : at + step, None] != block[at:]
        flat = np.flatnonzero(near)
        for k in range(0, len(flat), PAIRS):
            i, j = np.divmod(flat[k : k + PAIRS], near.shape[1])
            i, j = i + at, j + at
            root = roots(i, j, n, root)
            # the first leaf that both share counts the pair
            kinds, which = np.unique(pattern[i] * len(leaves) + pattern[j], return_inverse=True)
            p, q = np.divmod(kinds, len(leaves))
            earlier = np.zeros(len(kinds), bool)
            for c in range(leaves.shape[1]):
                mine = leaves[p, c]
                earlier |= (mine >= 0) & (leaves[q] == mine[:, None]).any(axis=1)
            new = ~earlier[which]
            links += np.bincount(i[new], copies[j[new]], n).astype(np.int64) + np.bincount(j[new], copies[i[new]], n).astype(np.int64)
    some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
    kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(moved)])
    return pa.table({"kind": kind, "a": ids[np.concatenate([some, moved])], "b": np.concatenate([links[some], ids[root[moved]]])})


def _dealt(placed: DataFrame, reps: DataFrame, group: int) -> DataFrame:
    """placed with block, and i and j: the pair of blocks that the row is compared in, a row for each such pair."""
    limit = F.least(F.lit(float(group)), F.greatest(F.lit(1.0), F.lit(float(GROUP_BYTES)) / (8 * F.col("dim"))))
    if reps.groupBy("label", "dim").count().where(F.col("count") > limit).isEmpty():  # no leaf of a label is larger than the label
        return placed.select("*", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    leaves = placed.groupBy("label", "dim", "code").count().where(F.col("count") > limit)
    leaves = leaves.select("label", "dim", "code", F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
    both = placed.join(leaves, ["label", "dim", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    both = both.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks").cast("long")).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("blocks", "other")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their vectors equally long and their cosine at
    least `cosine`. Vectors that are null, empty or zero or hold a null or non-finite part, and rows without a vec_id,
    link with nothing and are kept. Equal vectors of a label link; repeated rows count as copies. An
    empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding")
    part = F.col("embedding")
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(part, lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.withColumn("fine", fine).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    good = rows.where("fine")
    reps = good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    reps = settle(reps.withColumn("dim", F.size("embedding")))
    dims = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    main, total = (dims[0]["dim"], dims[0]["count"]) if dims else (0, 0)
    sample = min(sample, max(SAMPLE_BYTES // (8 * max(main, 1)), 1))
    taken = reps.where(F.col("dim") == main).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select("embedding").toArrow()
    depth = max(0, min(int(np.ceil(np.log2(max(total, 1) / leaf))), int(np.log2(max(len(taken), 1) / LEAST))))
    fit = np.array(taken["embedding"].combine_chunks().flatten(), np.float64).reshape(len(taken), -1) if len(taken) else np.zeros((0, main))
    forest = spark.sparkContext.broadcast(Forest(_unit(fit) if len(fit) else fit, depth, trees, cosine))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dim").to_numpy()
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                given = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                given = given.astype(given.dtype if given.dtype in (np.float32, np.float64) else np.float64).reshape(part.num_rows, int(dim))
                x = _unit(given.astype(np.float64))
                # other lengths are rare: one leaf each
                row, code = forest.value.leaves(x) if dim == main else (np.arange(len(x)), np.zeros(len(x), np.int32))
                cuts = np.searchsorted(row, np.arange(len(x) + 1))
                raw, codes = [v.tobytes() for v in given], [code[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                take = lambda c: part.column(c).take(pa.array(row))
                columns = [take("label"), take("dim"), pa.array(code), take("id"), take("copies"), pa.array([raw[r] for r in row], pa.binary()), pa.array([codes[r] for r in row], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        return _leaf(key, table, cosine)

    placed = reps.select(F.col("label").cast("int"), "dim", "id", "copies", "embedding").mapInArrow(route, ROWS)
    dealt = _dealt(placed, reps, group).groupBy("label", "dim", "code", "i", "j")
    found = settle(dealt.applyInArrow(compared, "kind int, a long, b long"))
    labels = components(found.where("kind = 1").select("a", "b"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    ids = reps.select("label", "h1", "h2", "id", "copies").join(links, "id", "left").join(labels, F.col("id") == F.col("node"), "left")
    ids = settle(ids.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("root")))
    forget(reps, found, labels)
    keys = F.when(F.col("fine"), F.col("label")).alias("label")
    out = rows.select("vec_id", "fine", keys, "h1", "h2").join(ids, ["label", "h1", "h2"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: Every pair of a label is looked at: for small tables, where the forest finds every link.
ORACLE = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT reached.d, links.y FROM reached JOIN links ON reached.r = links.x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d AS vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(r) AS component_id, d = min(r) AS kept FROM reached LEFT JOIN counted ON x = d GROUP BY d
"""
