"""Audit of how far the sources of a language diverge, by a vocabulary automaton in two passes.

First pass: every task counts, chunk by chunk, the documents that hold a term; summed over all chunks these are exact document frequencies, and
decide which terms are kept. Second pass: for each chunk and language, an automaton of the kept terms in it, padded with blanks, runs over the
normalised texts and counts occurrences per source. Which terms are kept is told to the tasks by a bitmap of
fixed size, a bit for each term's hash: terms that share a bit with a kept one are counted in vain, and left out by a join. No vocabulary is
broadcast; an automaton is as large as its chunk's vocabulary, however many terms the corpus keeps.

The counts are sparse postings. Sums over all kept terms come from three parts: terms that neither source has are alike; what one
source has follows from how many of its terms have which share; only terms that both have are looked at in pairs, within a
term's posting list and added up by task, so that no pair of a term becomes a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BITMAP_BITS, bitmap, forget, is_set, looked_up, settle, slices

TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a kept term is in, at least; ranks of terms that are reported; the whole of a share.
LEAST, TOP, WHOLE = 3, 200, 1_000_000_000
#: Bytes of a normalised text: letters A to Z in lower case, what no term holds as blanks, the rest as it is.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Pairs of postings that a task looks at together.
PAIRS = 1 << 20


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict[str, dict[str, list[bytes]]]]:
    """Normalised texts of about `limit` bytes in all, by language and source."""
    chunk: dict[str, dict[str, list[bytes]]] = {}
    size = 0
    for part in slices(batches, limit=limit):
        own = pc.sum(pc.binary_length(part.column("text"))).as_py()
        if chunk and size + own > limit:
            yield chunk
            chunk, size = {}, 0
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text")):
            chunk.setdefault(lang, {}).setdefault(source, []).append(text.as_buffer().to_pybytes().translate(NORMAL))
        size += own
    if chunk:
        yield chunk


def document_frequencies(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms of normalised texts, and in how many of the texts each is."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.large_string()))
    words = split.flatten()
    # a blank at either end of a text leaves an empty word
    coded = words.dictionary_encode()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    size = max(len(coded.dictionary), 1)
    seen = np.unique(text * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    counts = np.bincount(seen % size, minlength=len(coded.dictionary)).astype(np.int32)
    full = np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)
    return coded.dictionary.take(pa.array(full)).cast(pa.string()), counts[full]


def vocabulary(texts: Iterable[bytes]) -> pa.Array:
    """Distinct terms of normalised texts."""
    terms = pc.unique(pa.concat_arrays([pc.unique(pc.ascii_split_whitespace(pa.array([t], pa.binary()).cast(pa.large_string())).flatten()) for t in texts]))
    return terms.filter(pc.greater(pc.binary_length(terms), 0)).cast(pa.string())


def occurrences(texts: Iterable[bytes], terms: list[str]) -> Iterator[np.ndarray]:
    """How often each term is in each of the normalised texts, as a whole term."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, term in enumerate(terms):
        automaton.add_word(f" {term} ", k)
    automaton.make_automaton()
    for text in texts:
        yield np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(f" {text.decode()} ")) if terms else (), np.int64), minlength=len(terms))


def _bits(lang: str, terms: Iterable[str]) -> np.ndarray:
    """The bits of a language's terms, as _bit has them."""
    return np.array([xxhash.xxh64_intdigest(f"{lang}\n{t}", 42) >> 64 - BITMAP_BITS for t in terms], np.int64)


def _bit() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.concat("lang", F.lit("\n"), "term")), 64 - BITMAP_BITS)


def _frequencies(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches, limit):
        for lang, sources in chunk.items():
            terms, counts = document_frequencies([text for texts in sources.values() for text in texts])
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(terms)), terms, pa.array(counts, pa.int64())], ["lang", "term", "documents"])


def _counted(batches: Iterator[pa.RecordBatch], limit: int, kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n) of each chunk, for terms whose bit is set."""
    for chunk in _chunks(batches, limit):
        for lang, sources in chunk.items():
            texts = [b" ".join(own) for own in sources.values()]
            terms = vocabulary(texts)
            terms = terms.filter(pa.array(is_set(kept, _bits(lang, terms.to_pylist()))))
            for source, n in zip(sources, occurrences(texts, terms.to_pylist())):
                at = np.flatnonzero(n)
                same = [pa.repeat(pa.scalar(c, pa.string()), len(at)) for c in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, terms.take(pa.array(at)), pa.array(n[at], pa.int64())], ["lang", "source", "term", "n"])


def share(count: str, total: str, terms: str = "v") -> Column:
    """1 + floor(WHOLE * (count + 1) / (total + terms)) of columns, exact beyond 64 bits; null where there are no terms."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(20,0)) * cast({WHOLE} as decimal(10,0))) div nullif(cast({total} + {terms} as decimal(20,0)), 0)")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of columns: below 2^63, as shares are below 2^30 and a bit."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value): what the terms that two sources both have add to their sum, by task."""
    sums: dict[tuple[int, int], int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        a, b = zip(*sums) if sums else ((), ())
        batch = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sums.values(), pa.int64())], ["a", "b", "value"])
        sums.clear()
        return batch

    for batch in batches:
        lists = batch.column("list")
        g, p, absent = (lists.flatten().field(k).to_numpy() for k in range(3))
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # an entry meets the whole list it is in
        meets, first = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)
        names, code = np.unique(g, return_inverse=True)
        ends = np.cumsum(meets)
        at = 0
        while at < len(g):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(at, stop), meets[at:stop])
            j = np.arange(len(i)) - np.repeat(np.cumsum(meets[at:stop]) - meets[at:stop], meets[at:stop]) + first[i]
            i, j = i[code[i] != code[j]], j[code[i] != code[j]]
            value = _gap(p[i], p[j]) - _gap(p[i], absent[j]) - _gap(absent[i], p[j]) + _gap(absent[i], absent[j])
            pair = code[i] * len(names) + code[j]
            order = np.argsort(pair, kind="stable")
            starts = np.flatnonzero(np.diff(pair[order], prepend=-1))
            for k, v in zip(pair[order][starts].tolist(), np.add.reduceat(value[order], starts).tolist() if len(starts) else ()):
                sums[int(names[k // len(names)]), int(names[k % len(names)])] += v
            at = stop
            if len(sums) > PAIRS:
                yield out()
    yield out()


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, limit: int = BATCH_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank for each group of docs (text, lang, source).

    Part `pair`: how far the group's shares of the kept terms lie from those of each other source of its language. Part
    `term`: the terms that the group has more of than its language, the first `top`. Null text, lang and source are empty text; a group without terms
    has its pairs, and a language that keeps no term has pairs of value 0. Repeated rows count as often as they
    occur, equal values rank by item. An empty table gives no rows; other columns are ignored.
    """
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = text.mapInArrow(lambda batches: _frequencies(batches, limit), "lang string, term string, documents long").groupBy("lang", "term").agg(F.sum("documents").alias("documents"))
    kept = settle(counted.where(F.col("documents") >= least).select("lang", "term"))
    known = docs.sparkSession.sparkContext.broadcast(bitmap(kept.select(_bit().alias("bit"))))
    counts = text.mapInArrow(lambda batches: _counted(batches, limit, known.value), "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    postings = settle(counts.join(looked_up(kept), ["lang", "term"]))
    known.destroy()

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("has"))
    groups = text.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own", "has", "v"])
    groups = settle(groups.withColumn("absent", share("0", "own")).withColumn("g", F.monotonically_increasing_id()))
    forget(kept)
    totals = groups.groupBy("lang").agg(F.sum("own").alias("all"))
    near = looked_up(groups)
    shares = postings.join(near, ["lang", "source"]).select("lang", "term", "g", share("n", "own").alias("p"), "absent", "n", "v")
    entry = F.struct("g", "p", "absent")
    lists = settle(shares.groupBy("lang", "term").agg(F.collect_list(entry).alias("list"), F.sum("n").alias("n"), F.first("v").alias("v")))

    # what one source has, by how many of its terms have which share
    a, b = (near.select("lang", F.col("g").alias(x), F.col("absent").alias(f"{x}_absent"), F.col("has").alias(f"{x}_has"), F.col("v").alias(f"{x}_v")) for x in "ab")
    wide = lambda c: c.cast("decimal(38,0)")
    seen = shares.groupBy("lang", F.col("g").alias("a"), "p").agg(F.count("*").alias("times"))
    alone = seen.join(looked_up(groups).select("lang", F.col("g").alias("b"), F.col("absent").alias("b_absent")), "lang").where("a <> b")
    alone = alone.groupBy("a", "b").agg(F.sum(wide(F.col("times")) * gap("p", "b_absent").cast("decimal(19,0)")).alias("ab"), F.sum(wide(F.col("times")) * gap("b_absent", "p").cast("decimal(19,0)")).alias("ba"))
    alone = alone.select(F.explode(F.array(F.struct("a", "b", wide(F.col("ab")).alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), wide(F.col("ba")).alias("value")))).alias("x")).select("x.*")
    neither = (F.col("a_v") - F.col("a_has") - F.col("b_has")).cast("decimal(19,0)") * gap("a_absent", "b_absent").cast("decimal(19,0)")
    base = a.join(b, "lang").where("a <> b").select("a", "b", wide(F.coalesce(neither, F.lit(0))).alias("value"))
    met = lists.where(F.size("list") > 1).select("list").mapInArrow(_met, "a long, b long, value long").select("a", "b", wide(F.col("value")).alias("value"))
    pairs = settle(base.unionByName(alone).unionByName(met).groupBy("a", "b").agg(F.sum("value").cast("long").alias("value")))
    forget(postings)

    named = looked_up(groups)
    first, second = named.select(F.col("g").alias("a"), "lang", "source"), named.select(F.col("g").alias("b"), F.col("source").alias("item"))
    pair = pairs.join(first, "a").join(second, "b").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    found = lists.join(looked_up(totals), "lang").withColumn("q", share("n", "all")).select("lang", "term", "q", F.explode("list").alias("e")).select("term", "q", "e.g", "e.p")
    term = found.where("p > q").join(named.select("g", "lang", "source"), "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}')) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, sum(n) AS own FROM counted GROUP BY lang, source),
totals AS (SELECT lang, sum(n) AS own FROM counted GROUP BY lang),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // CAST(coalesce(s.own, 0) + z.v AS HUGEINT) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes z ON g.lang = z.lang
  LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
whole AS (
  SELECT t.lang, t.term, 1 + CAST(1000000000 AS HUGEINT) * (t.n + 1) // CAST(o.own + z.v AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term) t JOIN totals o ON t.lang = o.lang JOIN sizes z ON t.lang = z.lang),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
above AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - w.q) * (s.p - w.q) // w.q AS value
  FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INT) AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}
"""
