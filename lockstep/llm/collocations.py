"""Phrase collocation mining by level-wise passes.

Texts are packed into chunks of one language: the words of a chunk, numbered, and its running text as these numbers. Level 1
counts words. Every further level reads the chunks and emits a phrase of k words only where both phrases of k - 1 words that overlap
in it are frequent; the last level's frequent phrases are told to all tasks as one bitmap of fixed size, a bit for each phrase's hash. A bit that
belongs to another phrase too lets a candidate more be counted, and none is lost. What is broadcast doesn't grow with the data.

Phrases are counted by 64-bit hashes, of which two among n are the same with probability about n^2 / 2^65. Of a frequent one, the text is sent once, by the chunk
with the least tag of those that hold it: texts are as many as frequent phrases, however many tasks there are.

Cuts are scored from the level tables, in decimals: both parts of a frequent phrase are frequent themselves.
"""

from __future__ import annotations

import secrets
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap, forget, is_set, looked_up, settle, slices

#: Words of a phrase at most, occurrences of a candidate at least, phrases of a language that are reported.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Texts as they are split: A to Z in lower case, what ends a piece as a full stop, tabs as blanks.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
CHUNKS = "tag long, lang string, words array<string>, counts array<long>, codes binary"
#: Text bytes of a chunk: what a task holds of one at each level is some twenty times as much.
CHUNK_BYTES = 4 << 20
#: Chunks in a batch.
CHUNK_ROWS = 4
#: Phrases in a batch, and parts that a language's phrases are ranked in before the last ranking.
PHRASES, PARTS = 1 << 16, 64


def _packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    texts: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for part in slices(batches, limit=limit):
        own = pc.sum(pc.binary_length(part.column("text"))).as_py()
        if texts and size + own > limit:
            yield from (_chunk(lang, own) for lang, own in texts.items())
            texts.clear()
            size = 0
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
            texts[lang].append(text.as_buffer().to_pybytes().translate(NORMAL))
        size += own
    yield from (_chunk(lang, own) for lang, own in texts.items())


def numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of normalised texts, and the texts as numbers of these, with -1 where a piece ends."""
    whole = b".".join(texts).replace(b".", b" . ").strip()
    if not whole:
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    coded = pc.ascii_split_whitespace(pa.array([whole], pa.binary()).cast(pa.large_string())).flatten().dictionary_encode()
    words, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False)
    stop = pc.index(words, ".").as_py()
    if stop >= 0:
        codes = np.where(codes == stop, -1, codes - (codes > stop))
        words = pa.concat_arrays([words[:stop], words[stop + 1 :]])
    return words, codes.astype(np.int32)


def _chunk(lang: str, texts: list[bytes]) -> pa.RecordBatch:
    words, codes = numbered(texts)
    counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.int64)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts))]
    return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(31)]), pa.array([lang], pa.string()), *lists, pa.array([stored(codes)], pa.binary())], [c.split()[0] for c in CHUNKS.split(", ")])


def stored(codes: np.ndarray) -> bytes:
    """Numbers from -1 on as bytes: their low bytes, then their next ones, up to those that are needed, which leaves little once it is compressed."""
    planes = (codes.astype("<u4") + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T
    need = next((k for k in (4, 3, 2) if len(codes) and planes[k - 1].any()), 1)
    return bytes([need]) + planes[:need].tobytes()


def restored(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros(planes.shape[1], np.int32)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.int32) << 8 * k
    return out - 1


def hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def joined(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    out = (first ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def bits(hashed: np.ndarray) -> np.ndarray:
    """The bit of each hash: its first bits."""
    return (hashed >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit of each (lang, phrase)."""
    for batch in batches:
        found = np.zeros(batch.num_rows, np.uint64)
        for k, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())):
            value = hashes([lang])
            for word in hashes(phrase.split(" ")):
                value = joined(value, word)
            found[k] = value[0]
        yield pa.RecordBatch.from_arrays([pa.array(bits(found))], ["bit"])


def told(frequent: DataFrame) -> np.ndarray:
    """The bitmap of frequent phrases (lang, phrase)."""
    return bitmap(frequent.select("lang", "phrase").mapInArrow(_set_bits, "bit long"))


def candidates(lang: str, words: pa.Array, codes: np.ndarray, k: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of k words begin whose first and last k - 1 words are in the bitmap, and their hashes."""
    n = len(codes) - k + 1
    if n <= 0 or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = hashes(words.to_pylist())[codes]
    whole = codes >= 0
    value = np.repeat(hashes([lang]), n + 1)
    inside = np.ones(n + 1, bool)
    for j in range(k - 1):
        value = joined(value, word[j : j + n + 1])
        inside &= whole[j : j + n + 1]
    known = inside & is_set(frequent, bits(value))
    at = np.flatnonzero(known[:-1] & known[1:])
    return at, joined(value[at], word[at + k - 1])


def phrases(words: pa.Array, codes: np.ndarray, k: int, at: np.ndarray) -> pa.Array:
    """The texts of the k words from each place on."""
    return pc.binary_join_element_wise(*[words.take(pa.array(codes[at + j])) for j in range(k)], " ")


def tagged(value: np.ndarray, tag: int) -> np.ndarray:
    """The bits of phrases' hashes together with a chunk's tag."""
    return bits(joined(value, hashes([str(tag)])))


def _set_tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value, tag = batch.column("h").to_numpy().view(np.uint64), batch.column("tag").to_numpy()
        names, which = np.unique(tag, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(bits(joined(value, hashes([str(t) for t in names.tolist()])[which])) if len(value) else np.zeros(0, np.int64))], ["bit"])


def level(chunks: DataFrame, last: DataFrame, k: int, least: int) -> DataFrame:
    """(lang, phrase, n): the frequent phrases of k words, from those of k - 1."""
    context = chunks.sparkSession.sparkContext
    frequent = context.broadcast(told(last))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for tag, lang, words, data in zip(batch.column("tag").to_pylist(), batch.column("lang").to_pylist(), batch.column("words"), batch.column("codes")):
                codes = restored(data.as_buffer().to_pybytes())
                yield tag, lang, words.values, codes, *candidates(lang, words.values, codes, k, frequent.value)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tag, _, _, _, _, value in found(batches):
            own, counts = np.unique(value, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts), pa.array(np.full(len(own), tag, np.int64))], ["h", "n", "tag"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tag, lang, words, codes, at, value in found(batches):
            own, first = np.unique(value, return_index=True)
            mine = is_set(many.value, tagged(own, tag))
            for start in range(0, int(mine.sum()), PHRASES):
                text = phrases(words, codes, k, at[first[mine][start : start + PHRASES]])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(text)), text, pa.array(own[mine][start : start + PHRASES].view(np.int64))], ["lang", "phrase", "h"])

    running = chunks.select("tag", "lang", "words", "codes")
    by_hash = running.mapInArrow(counted, "h long, n long, tag long").groupBy("h").agg(F.sum("n").alias("n"), F.min("tag").alias("tag"))
    by_hash = settle(by_hash.where(F.col("n") >= least), CHUNK_ROWS)
    many = context.broadcast(bitmap(by_hash.select("h", "tag").mapInArrow(_set_tagged, "bit long")))
    # a bit that was set for another, or a tag that two chunks have, sends a text again
    texts = running.mapInArrow(named, "lang string, phrase string, h long").dropDuplicates(["lang", "phrase"])
    out = settle(texts.join(by_hash.select("h", "n"), "h").select("lang", "phrase", "n"), CHUNK_ROWS)
    frequent.destroy()
    many.destroy()
    forget(by_hash)
    return out


def cut_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) of columns, exact beyond 64 bits."""
    wide = lambda c: f"cast({c} as decimal(18,0))"
    return F.expr(f"({wide(a)} * {wide(n)} * cast(1000 as decimal(4,0))) div ({wide(left)} * {wide(right)})")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, limit: int = CHUNK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to `longest` words with the highest scores of each language of docs (text, lang).

    Null texts are empty, null languages `und`. Repeated rows count as often as they occur. A language without
    candidates has no row, an empty table gives none; equal scores rank by a, then by phrase. Other columns are ignored.
    """
    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunks = settle(text.mapInArrow(lambda batches: _packed(batches, limit), CHUNKS), compression="zstd")
    counted = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("n"))
    counted = settle(counted)
    totals = settle(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    levels = [settle(counted.where(F.col("n") >= least))]
    forget(counted)
    for k in range(2, longest + 1):
        levels.append(level(chunks, levels[-1], k, least))
    forget(chunks)

    table = levels[0].withColumn("size", F.lit(1))
    for k, own in enumerate(levels[1:], 2):
        table = table.unionByName(own.withColumn("size", F.lit(k)))
    table = table.withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    several = table.where("size > 1")
    # a phrase is dropped where one that is a word longer is as frequent: of two that are further apart, those between are as frequent too
    inner = F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1)))
    longer = several.where("size > 2").select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = several.join(longer, ["lang", "phrase"], "left").where("inside IS NULL OR inside < a").drop("inside")
    cuts = left.join(looked_up(totals), "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    parts = table.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    cuts = cuts.join(parts, ["lang", "first"]).join(parts.select("lang", F.col("first").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", cut_score("a", "n", "l", "r"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = scored.withColumn("__place", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*best))).where(F.col("__place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
sized AS (SELECT lang, w, i, k FROM placed, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i + k - 1 <= len(w)),
counted AS (SELECT lang, k AS size, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS a FROM sized GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(a) AS n FROM counted WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND a >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, array_to_string(list_slice(w, 1, k), ' ') AS left_part, array_to_string(list_slice(w, k + 1, c.size), ' ') AS right_part
  FROM candidates c, (SELECT unnest(range(1, {LONGEST})) AS k) WHERE k < c.size),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.size, cuts.a, k, x.a AS l, y.a AS r, t.n, CAST(1000 AS HUGEINT) * cuts.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts JOIN totals t ON t.lang = cuts.lang
  JOIN counted x ON x.lang = cuts.lang AND x.phrase = left_part JOIN counted y ON y.lang = cuts.lang AND y.phrase = right_part),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
dropped AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates b
  ON s.lang = b.lang AND b.size > s.size AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank
  FROM lowest l LEFT JOIN dropped d ON l.lang = d.lang AND l.phrase = d.phrase WHERE o = 1 AND d.phrase IS NULL)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {TOP}
"""
