"""Divergence audit, collocations and nearest neighbours against plain versions."""

import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lockstep.llm import collocations, divergence, neighbours

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEYS = ["lang", "source", "part", "item", "value", "rank"]


def plain_audit(rows, least, top):
    counts, files, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(divergence.TERM_PATTERN, text.translate(LOWER))
        counts[lang, source].update(terms)
        files[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in files[lang].items() if n >= least]

        def shares(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        gap = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(gap(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-gap(own[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "limit"), [(3, 200, 1 << 20), (2, 5, 4000), (100, 3, 1 << 20)])
def test_audit_equals_plain_version(spark, docs, edges, least, top, limit):
    frame = docs.withColumnsRenamed({"node": "chunk", "size": "g", "doc": "term"})
    got = divergence.audit(frame, least, top, limit).select(*KEYS).collect()
    assert sorted(map(tuple, got)) == plain_audit([(r[1], r[2], r[3]) for r in edges], least, top)


def test_audit_of_terms_and_scripts(spark):
    rows = [("İST ist ıst É é ß ss", "a", "x"), ("ist_ist-ist IST\x00ist", "a", "y"), ("é日本é é", "a", "x"), ("ist é", "a", None), ("", "a", "z"), (None, "a", "w"), ("only here", "b", "x"), (None, None, None), ("a\nb\nc a", "", "x"), ("a\x7fb", "", "y"), ("a", "", "y")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    for least in (1, 2, 3):
        assert sorted(map(tuple, divergence.audit(frame, least).select(*KEYS).collect())) == plain_audit(rows, least, 200)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_audit_of_large_counts(spark):
    """Shares are exact where a count times the whole passes 64 bits."""
    frame = spark.createDataFrame([(9_300_000_000_000, 20_000_000_000_001, 3)], "n long, own long, v long")
    assert frame.select(divergence.share("n", "own")).first()[0] == 1 + 10**9 * (9_300_000_000_000 + 1) // (20_000_000_000_001 + 3)
    assert frame.select(divergence.gap("1000000001L", "1L")).first()[0] == 10**18


def test_pairs_of_long_lists_stay_small():
    """A term that many sources have: sums by pair of sources, in steps."""
    n, k = 700, 20
    rng = np.random.default_rng(1)
    entries = [[{"g": g, "p": int(rng.integers(1, 10**9)), "absent": 7} for g in range(n)] for _ in range(k)]
    batch = pa.RecordBatch.from_arrays([pa.array(entries, pa.list_(pa.struct({"g": pa.int64(), "p": pa.int64(), "absent": pa.int64()})))], ["list"])
    tracemalloc.start()
    got = [b.to_pydict() for b in divergence._met(iter([batch]))]
    assert tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()
    sums = Counter()
    for b in got:
        for x, y, v in zip(b["a"], b["b"], b["value"]):
            sums[x, y] += v
    f = lambda p, q: (p - q) ** 2 // q
    for a, b in ((0, 1), (1, 0), (699, 3)):
        assert sums[a, b] == sum(f(e[a]["p"], e[b]["p"]) - f(e[a]["p"], 7) - f(7, e[b]["p"]) for e in entries)
    assert len(sums) == n * (n - 1)


def test_terms_of_a_very_long_text():
    text = (" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}é" for k in range(700)) * 4000).encode()[: 20 << 20]
    text = text[: text.rindex(b" ")].translate(divergence.NORMAL)
    terms, counts = divergence.document_frequencies([text, b"waa\xc3\xa9"])
    assert dict(zip(terms.to_pylist(), counts.tolist()))["waaé"] == 2
    want = Counter(text.decode().split())
    some = sorted(want)[:50]
    assert next(divergence.occurrences([text], some)).tolist() == [want[t] for t in some]


def plain_phrases(rows, least, top, longest):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n, some = totals[lang], [p for p in f if len(p) > 1 and f[p] >= least]
        inside = {s for p in some for k in range(2, len(p)) for i in range(len(p) - k + 1) if f[s := p[i : i + k]] == f[p]}
        found = []
        for p in some:
            if p not in inside:
                score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -f[p], " ".join(p).encode(), p, f[p[:k]], f[p[k:]]))
        out += [(lang, r, " ".join(p), -a, left, right, n, -score) for r, (score, a, _, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "longest", "limit"), [(2, 2000, 5, 1 << 20), (3, 7, 5, 3000), (5, 50, 3, 500), (100, 2000, 5, 1 << 20)])
def test_phrases_equal_plain_version(spark, docs, edges, least, top, longest, limit):
    frame = docs.withColumnsRenamed({"node": "n", "size": "phrase", "doc": "words"})
    got = collocations.mine(frame, least, top, longest, limit).collect()
    assert sorted(map(tuple, got)) == plain_phrases([(r[1], r[2]) for r in edges], least, top, longest)


def test_phrases_of_overlaps_and_languages(spark):
    rows = [("a a a a a a. a a", "x"), ("A\tA B-c\nd", "x"), ("new york city, new york city; york city", None), ("new york city", "und"), ("...", "y"), ("", "z"), (None, None), ("é é\x1cé é é", ""), (" . lone . ", "x")] * 3
    frame = spark.createDataFrame(rows, "text string, lang string")
    for least in (1, 3, 6):
        assert sorted(map(tuple, collocations.mine(frame, least).collect())) == plain_phrases(rows, least, 2000, 5)
    assert collocations.mine(frame.limit(0)).count() == 0


def emitted(lang, words, codes, k, told):
    at, _ = collocations.candidates(lang, words, codes, k, told)
    return Counter(collocations.phrases(words, codes, k, at).to_pylist())


def test_phrases_with_a_crowded_bitmap():
    """Every bit set: more candidates, the same counts."""
    words, codes = collocations.numbered([b"one two three one two. one two four".translate(collocations.NORMAL), b"one two"])
    full = np.full((1 << collocations.BITMAP_BITS) // 8, 255, np.uint8)
    assert emitted("x", words, codes, 2, full) == {"one two": 4, "two three": 1, "three one": 1, "two four": 1}
    assert not emitted("x", words, codes, 2, np.zeros_like(full)) and not emitted("x", words, codes[:1], 2, full) and not emitted("x", words[:0], codes[:0], 2, full)


def test_only_phrases_of_frequent_phrases_are_counted(spark):
    frequent = spark.createDataFrame([("x", "one two"), ("x", "two three"), ("y", "three one")], "lang string, phrase string")
    told = collocations.told(frequent)
    assert np.unpackbits(told).sum() == 3
    words, codes = collocations.numbered([b"one two three one two"])
    assert emitted("x", words, codes, 3, told) == {"one two three": 1}
    # a phrase's hash is the same whether it is made of a text or of its words
    pair = collocations.candidates("x", words, codes, 2, np.full_like(told, 255))[1][0]
    assert np.unpackbits(told, bitorder="little")[collocations.bits(np.array([pair]))[0]] == 1


@pytest.mark.parametrize("most", [0, 1, 254, 255, 65_534, 65_535, 1 << 24])
def test_numbers_are_stored_by_bytes(most):
    codes = np.array([-1, 0, most, -1, most // 2], np.int32)
    assert (collocations.restored(collocations.stored(codes)) == codes).all() and not len(collocations.restored(collocations.stored(codes[:0])))


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 4_000_000_000_000, 20_000_000_000_000, 5_000_000_000_001, 4_000_000_000_003
    frame = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert frame.select(collocations.cut_score("a", "n", "l", "r")).first()[0] == 1000 * a * n // (left * right)


def test_words_of_a_very_long_text():
    text = (b"some words, " * 2_000_000)[: 20 << 20].translate(collocations.NORMAL)
    tracemalloc.start()
    words, codes = collocations.numbered([text])
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    assert words.to_pylist()[:2] == ["some", "words"] and (codes == 0).sum() == text.count(b"some")


def plain_nearest(rows, k):
    fine = {}
    for d, v in rows:
        x = None if v is None or d is None or not len(v) or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        if x is not None and np.isfinite(x).all() and x.any():
            fine[d] = x / np.abs(x).max()
    out = []
    for q, x in fine.items():
        if q % neighbours.EVERY == 0:
            # numbers of one size: the same sum in the same order as in the operator
            score = lambda y, x=x: sum_in_order(x * y) / (sum_in_order(x * x) ** 0.5 * sum_in_order(y * y) ** 0.5)
            found = sorted((-score(y), d) for d, y in fine.items() if d != q and len(y) == len(x))[:k]
            out += [(q, r, d, -s) for r, (s, d) in enumerate(found, 1)]
    return sorted(out)


def sum_in_order(x):
    total = 0.0
    for k, v in enumerate(x.tolist()):
        total = v if k == 0 else total + v
    return total


@pytest.mark.parametrize(("block", "run"), [(65_536, 8192), (70, 2)])
def test_neighbours_of_odd_vectors(spark, block, run):
    """Nulls, zeros, copies, ties, repeated rows and other lengths; few rows, so that the forest looks at all that may be near."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(260)]
    rows += [(300 + k, rows[k][1]) for k in range(0, 120, 3)] + [(400 + k, [2 * x for x in rows[0][1]]) for k in range(4)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e-30] * 8, [1e30] * 8]
    rows += [(500 + 50 * k, v) for k, v in enumerate(odd)] + [(None, rows[0][1]), (None, None), (5000, [1.0, 2.0, 3.0])]
    again = [rows[0], rows[7], rows[50]]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + again], "vec_id long, embedding array<float>, id string, rank int")
    got = neighbours.search(frame, frame.where("vec_id % 50 = 0"), miss=1e-6, block=block, run=run).collect()
    assert sorted(map(tuple, got)) == plain_nearest(rows, neighbours.K)


@pytest.mark.parametrize("block", [65_536, 100])
def test_neighbours_of_an_id_that_many_rows_share(spark, block):
    """Copies of one row, and vectors of its own for each row of an id, push no other out."""
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(60)]
    near = rows[0][1]
    rows += [(7001, [x + 1e-3 for x in near])] * 300 + [(7002, [x + 1e-3 * float(rng.normal()) for x in near]) for _ in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [(r.rank, r.vec_id, r.score) for r in neighbours.search(frame, frame.where("vec_id = 0"), miss=1e-6, block=block).orderBy("rank").collect()]
    x = {}
    for d, v in rows:
        x.setdefault(d, []).append(np.array(v, np.float32).astype(float))
    q = x[0][0]
    best = sorted((-max(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)) for v in own), d) for d, own in x.items() if d)[:5]
    assert [g[:2] for g in got] == [(k, d) for k, (_, d) in enumerate(best, 1)] and all(abs(g[2] + b[0]) < 1e-12 for g, b in zip(got, best))


def test_neighbours_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.evaluated(empty).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.evaluated(one).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in neighbours.evaluated(few).orderBy("rank").collect()] == [(1, 2), (2, 3)]


@pytest.mark.parametrize(("spread", "most"), [(None, 0.8), (0.1, 0.02)])
def test_recall_against_brute_force(spread, most):
    """Default parameters: recall is at least 0.95 where no vector is near, and where neighbours are near few rows are compared."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 64))
    if spread:
        x = x[rng.integers(0, 500, 20_000)] + spread * x[rng.permutation(20_000)]
    ids = np.arange(20_000)
    some = ids[::250]
    query, found, _, compared = neighbours.nearest(x, ids, x[some], some)
    got = defaultdict(set)
    for q, v in zip(query, found):
        got[q].add(v)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in some:
        near = unit @ unit[q]
        near[q] = -2
        hits += len(got[q] & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.95 * 5 * len(some) and compared <= most * len(some) * len(x)
