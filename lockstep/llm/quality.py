"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated.

Random Fourier features approximate a Gaussian kernel over standardised statistics of whole texts.
Tasks sum the normal equations of their rows, the sums are added row by row of the matrix
across tasks, and only the summed matrix comes to the driver. Raw scores become probabilities by isotonic
regression on labelled rows that the ridge did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, forget, settle, slices, text_bytes
from .shingles import STEP, groups, sets_of_words, words

FEATURES, RIDGE, SEED = 384, 1.0, 29
#: Kernel width in standard deviations, by the square root of the number of statistics.
WIDTH = 1.0
PART_BYTES = 1 << 20
FOLDS, HELD_OUT = 3, 1
#: One in so many learning rows is for calibration. Raw scores are binned this finely for it.
CALIBRATE, BINS = 5, 1000
#: Bytes whose share of a text is a statistic, by class.
MARKS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "|", "*#$%&@^~", "\n", " \t\r", "'\"()[]-/")


@cache
def _classes() -> np.ndarray:
    out = np.full(256, len(MARKS), np.int64)
    for k, chars in enumerate(MARKS):
        out[[ord(c) for c in chars]] = k
    out[128:] = len(MARKS) + 1
    return out


STATISTICS = 2 + len(MARKS) + 2 + 9


def word_statistics(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(3, n): different words, occurrences of the most frequent one, and words that follow themselves, of each text."""
    out = np.zeros((3, len(at) - 1))
    for a, b in groups(at):
        mine = word[at[a] : at[b]]
        if b - a == 1:
            order, own = np.sort(mine), None
            cut = np.concatenate([[True], order[1:] != order[:-1]]) if len(mine) else np.zeros(0, bool)
            same = mine[1:] == mine[:-1]
        else:
            own = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
            by = np.lexsort((mine, own))
            order, of = mine[by], own[by]
            cut = np.concatenate([[True], (order[1:] != order[:-1]) | (of[1:] != of[:-1])]) if len(mine) else np.zeros(0, bool)
            same = (mine[1:] == mine[:-1]) & (own[1:] == own[:-1])
        first = np.flatnonzero(cut)
        times = np.diff(np.append(first, len(mine)))
        if own is None:
            out[:, a] = len(first), times.max(initial=0), same.sum()
        else:
            out[0, a:b] = np.bincount(of[first], minlength=b - a)
            np.maximum.at(out[1, a:b], of[first], times)
            out[2, a:b] = np.bincount(own[1:][same], minlength=b - a)
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """(n, STATISTICS) of whole texts; an empty text has zeros. Bytes are counted in windows: a long text takes no more beside its words."""
    data, bounds = text_bytes(column)
    n, kinds = len(bounds) - 1, len(MARKS) + 2
    size = np.diff(bounds)
    marks = np.zeros(n * kinds, np.int64)
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        own, stop = np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, b)
        text = np.repeat(np.arange(own, stop), np.diff(np.clip(bounds[own : stop + 1], a, b)))
        marks += np.bincount(text * kinds + _classes()[data[a:b]], minlength=n * kinds)
    share = marks.reshape(n, kinds) / np.maximum(size, 1)[:, None]
    word, at = words(data, bounds)
    count = np.diff(at)
    distinct, most, again = word_statistics(word, at)
    cuts = sets_of_words(word, at)[1]
    some = np.maximum(count, 1)
    letters = np.maximum(share[:, 0] + share[:, 1] + share[:, -1], 1e-9)
    out = [
        np.log1p(size), np.log1p(count), *share.T,
        size / some, distinct / some, distinct / np.sqrt(some), most / some, again / some,
        np.diff(cuts) / np.maximum(count - 4, 1), share[:, 0] / letters, share[:, 4:7].sum(axis=1) * size / some, np.log1p(size / (1 + share[:, 7] * size)),
    ]
    return np.stack(out, 1) * (size > 0)[:, None]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the features and the constant
    raw: np.ndarray  # ascending raw scores with ...
    probability: np.ndarray  # ... their calibrated ones

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS))
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + rng.uniform(0, 2 * np.pi, FEATURES)), np.ones((len(x), 1))])

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_scores(x), self.raw, self.probability)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing fit to weighted means y at ascending x, by pooling violators."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a, b, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, w2 = blocks.pop()
            a1, b1, w1 = blocks[-1]
            blocks[-1] = [(a1 * w1 + a2 * w2) / (w1 + w2), (b1 * w1 + b2 * w2) / (w1 + w2), w1 + w2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(text_bytes(column)[0].tobytes(), np.float64).reshape(-1, STATISTICS)


def fit(rows: DataFrame) -> Model:
    """A model from rows (stats binary, quality, calibrate boolean); quality is 0 or 1."""
    sc = rows.sparkSession.sparkContext

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, STATISTICS))
        for b in batches:
            x = _matrix(b.column(0))
            total += np.stack([np.full(STATISTICS, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STATISTICS, dtype=np.int32)), *map(pa.array, total)], ["k", "n", "s", "q"])

    sums = rows.select("stats").mapInArrow(moments, "k int, n double, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").collect()
    n = sums[0]["n"] if sums else 0
    if not n:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    mean = np.array([r["s"] / n for r in sums])
    spread = np.sqrt(np.maximum(np.array([r["q"] / n for r in sums]) - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    shared = sc.broadcast(model)
    width = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((width, width + 1))
        for b in batches:
            z = shared.value.features(_matrix(b.column(0)))
            left += z.T @ np.hstack([z, b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([r.tobytes() for r in left], pa.binary())], ["k", "part"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(width + 1)
        for part in table["part"].to_pylist():
            total += np.frombuffer(part, np.float64)
        return pa.table({"k": table["k"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    learn = rows.where("NOT calibrate").select("stats", "quality")
    parts = learn.mapInArrow(equations, "k int, part binary").groupBy("k").applyInArrow(added, "k int, part binary").orderBy("k").collect()  # the matrix, of fixed size
    system = np.stack([np.frombuffer(r["part"], np.float64) for r in parts]) if parts else np.zeros((width, width + 1))
    penalty = np.eye(width) * RIDGE
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(system[:, :width] + penalty, system[:, width])
    shared = sc.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = shared.value.raw_scores(_matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(raw * BINS), -BINS, 2 * BINS).astype(np.int32)), pa.array(raw), b.column(1)], ["bin", "raw", "quality"])

    spare = rows.where("calibrate").select("stats", F.col("quality").cast("double")).mapInArrow(binned, "bin int, raw double, quality double")
    bins = spare.groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("quality").alias("y")).orderBy("bin").collect()  # 3 * BINS rows at most
    if bins:
        model.raw, model.probability = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("raw", "y", "n")))
    else:
        model.raw, model.probability = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the statistics of each text, null ones as empty, as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in statistics(part.column(1))], pa.binary())], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats binary")


def evaluated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Learned from labels (doc_id, quality) outside the held-out fold; null labels and null ids are not used,
    repeated labels count as often as they come. Null and empty texts are scored as such. Without
    labels every score is 0.5. An empty table gives no rows; other columns are ignored.
    """
    stats = settle(with_statistics(docs))
    held_out = F.coalesce(crc_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    known = labels.where("quality IN (0, 1)").where(~held_out).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(CALIBRATE)) == 0
    rows = settle(stats.join(known, "doc_id").select("stats", "quality", calibrate.alias("calibrate")))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))
    forget(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.scores(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
