"""Language ID by the nearest of several centroids per language.

A text is the normalised TF-IDF vector of its hashed byte trigrams, letters lower-cased and all else
one blank. For each language the vectors of a bounded sample of labelled texts are clustered into a few
centroids on the unit sphere. A text gets the language of the centroid with the largest cosine,
and is rejected if that cosine is below the language's threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, forget, looked_up, settle, slices, text_bytes

DIMS = 4096
#: Labelled texts of a language that the model is fitted on, about and at most (twice this); and centroids of a language.
SAMPLE, CENTROIDS = 1500, 4
#: A text is rejected when its best cosine is below this part of the least cosine, but for LOWEST of them, of its language's sample.
#: Measured by leaving one language out in turn; the README has the shares.
REJECT, LOWEST = 0.75, 0.005
#: Texts of fewer different trigrams can only come so close: their threshold shrinks with the square root of the number.
FULL = 200
PART_BYTES, PART_ROWS, STEP = 1 << 20, 1 << 10, 1 << 20
UNKNOWN = "und"
FOLDS = 5


@cache
def _classes() -> np.ndarray:
    """Bytes to themselves if they can be of a letter, else to a blank."""
    out = np.full(256, 32, np.uint8)
    for a, b in ((ord("a"), ord("z")), (ord("A"), ord("Z")), (128, 255)):
        out[a : b + 1] = np.arange(a, b + 1)
    return out


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, dimension, times) of the trigrams of each text, which are counted in windows: a long text takes no more than a short one."""
    data, bounds = text_bytes(pc.utf8_lower(texts))
    edges = np.unique(bounds)
    times = np.zeros((len(bounds) - 1) * DIMS, np.int64)
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        byte = _classes()[data[a:b]].astype(np.int64)
        beside = _classes()[data[[max(a - 1, 0), min(b, len(data) - 1)]]]
        before, after = np.concatenate([beside[:1], byte[:-1]]), np.concatenate([byte[1:], beside[1:]])
        lo, hi = np.searchsorted(edges, (a, b + 1))
        begin, end = edges[lo:hi], edges[lo:hi] - 1
        before[begin[begin < b] - a], after[end[end >= a] - a] = 32, 32
        gram = before << 16 | byte << 8 | after
        # a trigram that begins or ends a run of blanks says nothing
        use = (byte != 32) | ((before != 32) & (after != 32))
        dim = (gram * 0x9E3779B1 >> 15) & (DIMS - 1)
        own, stop = np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, b)
        text = np.repeat(np.arange(stop - own), np.diff(np.clip(bounds[own : stop + 1], a, b)))
        times[own * DIMS : stop * DIMS] += np.bincount((text * DIMS + dim)[use], minlength=(stop - own) * DIMS)
    at = np.flatnonzero(times)
    return at // DIMS, at % DIMS, times[at]


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    text, dim, times = counts(texts)
    out = np.zeros((len(texts), DIMS), np.float32)
    out[text, dim] = (1 + np.log(times)) * idf[dim]
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    centers = [x.mean(axis=0)]
    while len(centers) < min(k, len(x)):
        near = (x @ _unit(np.stack(centers)).T).max(axis=1)
        weight = np.maximum(1 - near, 1e-9).astype(np.float64)
        centers.append(x[rng.choice(len(x), p=weight / weight.sum())])
    c = _unit(np.stack(centers))
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray  # a centroid's language
    least: np.ndarray  # a language's rejection threshold

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, rejected) of each text."""
        x = vectors(texts, self.idf)
        near = x @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(near)), best], 0, 1).astype(np.float64)
        least = self.least[self.of[best]] * np.sqrt(np.minimum((x > 0).sum(axis=1) / FULL, 1))
        return self.of[best], score, score < least


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model from docs' text and lang; rows with a null in either are not used.

    Document frequencies are of all these rows. For the centroids, about `sample` whole texts of each language are used, chosen by a hash of doc_id and text.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    totals = settle(labelled.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")))
    many = totals.agg(F.sum("n")).first()[0]
    if not many:
        return Model([], np.ones(DIMS), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    chosen = labelled.join(looked_up(totals), F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1 << 30)) < F.least(F.lit(1.0), sample / F.col("n")) * float(1 << 30))
    schema = "lang string, dims binary, times binary"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES, rows=PART_ROWS):
            text, dim, times = counts(part.column(0))
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
            pairs = list(zip(cuts, cuts[1:]))
            dim, times = dim.astype(np.uint16), times.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([dim[a:b].tobytes() for a, b in pairs]), pa.array([times[a:b].tobytes() for a, b in pairs])], ["lang", "dims", "times"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(DIMS, np.int64)
        for part in slices(batches, limit=PART_BYTES, rows=PART_ROWS):
            have += np.bincount(counts(part.column(0))[1], minlength=DIMS)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(have[at], pa.int64())], ["dim", "n"])

    rows = settle(chosen.select("text", "lang").mapInArrow(counted, schema))
    idf = np.zeros(DIMS)
    # of all learning rows, a row per dimension
    for r in labelled.select("text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        idf[r["dim"]] = r["n"]
    idf = np.log((1 + many) / (1 + idf)) + 0.1

    def clustered(key: tuple, table: pa.Table) -> pa.Table:
        x = np.zeros((len(table), DIMS), np.float32)
        for k, (dims, times) in enumerate(zip(table["dims"].to_pylist(), table["times"].to_pylist())):
            dim = np.frombuffer(dims, np.uint16)
            x[k, dim] = (1 + np.log(np.frombuffer(times, np.uint32))) * idf[dim]
        x = _unit(x[(x > 0).any(axis=1)])
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        c = cluster(x, centroids)
        least = REJECT * float(np.quantile((x @ c.T).max(axis=1), LOWEST))
        return pa.table({"lang": [key[0].as_py()] * len(c), "centroid": pa.array([v.tobytes() for v in c], pa.binary()), "least": [least] * len(c)})

    found = rows.groupBy("lang").applyInArrow(clustered, "lang string, centroid binary, least double").orderBy("lang").collect()  # a few rows per language
    forget(rows, totals)
    languages = sorted({r["lang"] for r in found})
    of = np.array([languages.index(r["lang"]) for r in found], int)
    least = np.array([next(r["least"] for r in found if r["lang"] == x) for x in languages])
    return Model(languages, idf, np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32), of, least)


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, lang, score, rejected): each row of docs as a struct, and what the model says of its text.

    Texts that are null or have no letter are UNKNOWN with score 0 and rejected, and so is every text if the
    model knows no language. Repeated rows give a row each; an empty table stays empty; whatever columns docs
    has stay in the struct.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), has_letter().alias("letter"))
    schema = rows.select("doc").schema.add("lang", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            doc = batch.column(0)
            # null texts are filled for the vectors only; the rows go out as they came
            keyed = pa.RecordBatch.from_arrays([doc.field("text"), pa.array(np.arange(batch.num_rows))], ["text", "row"])
            for part in slices(iter([keyed]), limit=PART_BYTES, rows=PART_ROWS):
                rows = batch.slice(part.column(1)[0].as_py(), part.num_rows)
                letter = rows.column(1).to_numpy(zero_copy_only=False)
                if own.languages:
                    which, score, out = own.predict(part.column(0))
                    lang = np.where(letter, np.array(own.languages, object)[which], UNKNOWN)
                    score, out = np.where(letter, score, 0.0), out | ~letter
                else:
                    lang, score, out = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], schema.names)

    return rows.mapInArrow(run, schema)


def evaluated(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the folds that are not held out."""
    held_out = F.coalesce(crc_bucket("doc_id", FOLDS) == 0, F.lit(False))
    model = fit(docs.where(~held_out))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc.doc_id", "lang", "score", "rejected").select("doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows that the model, fitted on the same folds of docs, rejects; where no row has a lang to learn from, that is every row."""
    held_out = F.coalesce(crc_bucket("doc_id", FOLDS) == 0, F.lit(False))
    return predict(docs, fit(docs.where(~held_out))).where("NOT rejected").select("doc.*")
