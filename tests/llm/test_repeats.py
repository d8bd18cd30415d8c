"""Suffix dedup, Jaccard join, embeddings and components against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lockstep.llm import embedding_dedup, jaccard_join, shingles, suffix_dedup
from lockstep.llm.components import components, some_roots


def cut(texts, length):
    """Per text: bytes removed, runs, and what is left."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, y in zip(t, gone) if not y)
        out.append((len(t), len(t) - len(left), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(left).hexdigest(), left))
    return out


@pytest.mark.parametrize("order", [2, 3, 5, 7, 13])
def test_every_difference_is_covered(order):
    v, residues = suffix_dedup.difference_cover(order)
    assert {(a - b) % v for a in residues for b in residues} == set(range(v)) and len(residues) == order + 1


def repeated_bytes(texts, passage):
    return [w[1] for w in cut(texts, passage)]


@pytest.mark.parametrize(("length", "passage", "order", "bucket"), [(20, None, 3, 10**6), (30, 17, 3, 200), (400, None, 11, 10**6), (400, 320, 13, 1000)])
def test_suffix_dedup(spark, docs, edges, nothing, monkeypatch, length, passage, order, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_NAMES", bucket)
    monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", bucket)
    texts = [(r[1] or "").encode() for r in edges]
    want, more = cut(texts, length), repeated_bytes(texts, passage or min(length, suffix_dedup.PASSAGE))
    got = suffix_dedup.dedup(docs, length, passage, order, keep_text=True).collect()
    have = sorted((repr(r["doc_id"]), *tuple(r)[1:5], bytes(r["kept"]), r["n_repeated"]) for r in got)
    assert have == sorted((repr(e[0]), *w, n) for e, w, n in zip(edges, want, more))
    if bucket > 1000:
        assert suffix_dedup.dedup(nothing, length, order=order).count() == 0


@pytest.mark.parametrize(("partitions", "names"), [(1, 5), (4, 40), (29, 5)])
def test_suffix_dedup_of_random_texts(spark, monkeypatch, partitions, names):
    """Names of few bits send unequal strings to the sort, where bytes tell them apart."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", 300)
    if names < 40:
        monkeypatch.setattr(suffix_dedup, "fingerprints", lambda data, at, length: np.array([data[p] % names for p in at], np.uint64))
    rng = random.Random(8)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(10, 60))).decode() for _ in range(12)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    raw = [t.encode() for t in texts]
    got = suffix_dedup.dedup(frame, 32, 16, 3).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == [(*w[:4], n) for w, n in zip(cut(raw, 32), repeated_bytes(raw, 16))]


def test_passages_of_over_fifty_words(spark):
    """Reported where they repeat, and left where no 400 bytes do; a run that begins or ends inside a word has one less."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    shared, fewer, copy = words(51), words(50), words(60)
    texts = [f"{words(30)} {shared} {words(30)}", f"{shared} {words(9)}", f"{words(9)} {fewer} {words(9)}", f"{fewer}zz {words(4)}", copy, copy, words(200)]
    rows = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_passages"] for r in rows] == [1, 1, 0, 0, 1, 1, 0] and not any(r["n_removed"] for r in rows)
    assert [r["n_repeated"] > 0 for r in rows] == [True] * 6 + [False]
    assert suffix_dedup.whole_words(b"ab cd ef", 0, 8) == 3 and suffix_dedup.whole_words(b"ab cd ef", 1, 7) == 1 and suffix_dedup.whole_words(b"ab cd ef", 2, 6) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=40, max_size=160), st.integers(15, 30))
def test_anchors_ranks_and_ties(letters, depth):
    """Equal strings have equal anchors; ties by ranks are those of the bytes, whatever the anchor's place."""
    data = np.array(letters, np.uint8)
    words = suffix_dedup._word(data)
    at = np.arange(len(data) - depth + 1)
    anchor = suffix_dedup.anchors(words, at, depth) - at
    same = {}
    for p, a in zip(at, anchor):
        assert 0 <= a <= depth - 8 and same.setdefault(data[p : p + depth].tobytes(), a) == a
    for first in range(8):
        cover = np.arange(first, len(data), 8)
        ranks = suffix_dedup.cover_ranks(words, cover, np.full(len(cover), len(data)), [suffix_dedup.blocks(depth)])[0]
        # aligned suffixes only: the same shift to the cover
        shift = (first - at) % 8
        fine = at + shift + 8 * suffix_dedup.blocks(depth) <= len(data)
        own, mine = at[fine], shift[fine]
        seen = Counter((data[p : p + depth].tobytes(), int(s)) for p, s in zip(own, mine))
        assert list(suffix_dedup.ties(words, own, mine, ranks, depth)) == [seen[data[p : p + depth].tobytes(), int(s)] > 1 for p, s in zip(own, mine)]


def words_of(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))


def set_of(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows, groups):
    """(doc_id, set size, component) of (doc_id, text) rows; rows are nodes."""
    sets = [set_of(t) for _, t in rows]
    own = groups(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                own.join(i, j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            r = own.find(k)
            least[r] = min(least.get(r, d), d)
    return sorted((repr(d), len(sets[k]), repr(least.get(own.find(k)) if sets[k] else d)) for k, (d, _) in enumerate(rows))


def answered(frame):
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in frame.collect())


def test_jaccard_join_on_edges(docs, edges, nothing, groups):
    assert answered(jaccard_join.components_of(docs)) == classes([r[:2] for r in edges], groups)
    assert jaccard_join.components_of(nothing).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    heads = {d for d, _, c in classes([r[:2] for r in edges], groups) if d == c}
    assert Counter(repr(r["doc_id"]) for r in kept.collect()) == Counter(repr(r[0]) for r in edges if repr(r[0]) in heads)


def test_pipeline_keeps_one_row_of_each_component(spark, docs, nothing):
    """Null and repeated ids decide nothing for rows of other components."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"{name}{rng.randrange(1000)}" for _ in range(60)) for name in "abcd")
    rows = [(1, a), (None, a + " more"), (None, b), (None, b + " more"), (None, b), (None, c), (2, d), (2, d + " more"), (3, d), (2, "alone here"), (2, "alone here"), (None, None), (None, None), (4, "")]
    frame = spark.createDataFrame([(*r, k % 2) for k, r in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    kept = corpus_pipeline.join_near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    families = [[(1, a)], [(None, b), (None, b + " more")], [(None, c)], [(2, d), (2, d + " more")], [(2, "alone here")]]
    assert len(got) == 8 and all(sum(x in f for x in got) == 1 for f in families)
    assert sorted(map(repr, (x for x in got if not x[1]))) == sorted(map(repr, [(None, None), (None, None), (4, "")]))
    assert corpus_pipeline.join_near_duplicates(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.join_near_duplicates(spark, nothing, "").count() == 0


@pytest.mark.parametrize(("seed", "spread"), [(1, 30), (2, 3)])
def test_jaccard_join_with_long_lists(spark, groups, seed, spread):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(4):  # families of near copies around the threshold, and a passage that all share
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 60))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own[: rng.randint(20, len(own))]))
    passage = " ".join(vocabulary[:25])
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = jaccard_join.components_of(spark.createDataFrame(rows, "doc_id long, text string"), often=3, longest=4, spread=spread)
    assert answered(got) == classes(rows, groups)


def test_overlaps_by_differences():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    sets = [np.sort(np.concatenate([np.delete(base, rng.integers(0, len(base), k)), rng.integers(0, 1 << 60, k).astype(np.uint64)])) for k in (0, 3, 9, 150, 390, 20)] + [np.zeros(0, np.uint64)]
    x, y = (np.array(v) for v in zip(*[(i, j) for i in range(7) for j in range(7) if i != j]))
    assert list(jaccard_join.overlaps(sets, x, y)) == [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(x, y)]


def test_reach_is_where_links_end():
    for size in range(1, 40):
        for place in range(size):
            can = [o for o in range(size, 80) if jaccard_join.can_link(np.array([size]), np.array([o]), np.array([place]), 0)[0]]
            most = int(jaccard_join.reach(np.array([size]), np.array([place]))[0])
            assert all(o <= most for o in can) and (most < size or most in can)


def test_texts_of_one_hash_are_nodes_of_their_own(spark, monkeypatch):
    """Where the first hash agrees and the second doesn't, texts are told apart."""
    real = F.xxhash64
    monkeypatch.setattr(jaccard_join.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if len(c) == 1 else real(*c))
    rows = [(0, "aa"), (1, "bb"), (2, "aa"), (3, "cc"), (4, "dddd"), (5, "dddd")]
    got = jaccard_join.with_nodes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    nodes = {}
    for r in got:
        nodes.setdefault(r["text"], set()).add(r["node"])
    assert all(len(v) == 1 for v in nodes.values()) and len({next(iter(v)) for v in nodes.values()}) == 4


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("aAbB \n\té", max_size=30), max_size=8))
def test_shingle_sets(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    names, cuts = shingles.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), bounds)
    known = {}
    for t, a, b in zip(texts, cuts, cuts[1:]):
        assert b - a == len(set_of(t)) and (np.diff(names[a:b].astype(object)) > 0).all()
        assert known.setdefault(frozenset(set_of(t)), tuple(names[a:b])) == tuple(names[a:b])
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize(("leaf", "trees", "group"), [(4096, 6, 10**6), (40, 12, 7)])
def test_embeddings(spark, groups, leaf, trees, group):
    rng = np.random.default_rng(4)
    vectors = []
    for k in range(60):
        base = rng.normal(size=16)
        for c in range(rng.integers(1, 6)):
            vectors.append((len(vectors), [float(x) for x in base + rng.normal(size=16) * 0.05 * c], k % 3))
    vectors += [(len(vectors) + k, v[1], v[2]) for k, v in enumerate(vectors[:10])]
    n = len(vectors)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-30] * 16, [1e30] * 16]
    vectors += [(n + k, v, 1) for k, v in enumerate(odd)] + [(n + 20, vectors[0][1], None), (n + 21, vectors[0][1], None), (None, vectors[0][1], 0), (None, None, None)]
    frame = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, label int, code string")
    got = embedding_dedup.near_duplicates(frame, leaf=leaf, trees=trees, group=group).collect()
    fine = []
    for d, v, label in vectors:
        x = None if not v or label is None or d is None or any(c is None for c in v) else np.array(v, np.float32).astype(np.float64)
        fine.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    own, links = groups(range(len(vectors))), Counter()
    for i in range(len(vectors)):
        for j in range(i):
            a, b = fine[i], fine[j]
            if a is not None and b is not None and vectors[i][2] == vectors[j][2] and len(a) == len(b):
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    own.join(i, j)
                    links[i] += 1
                    links[j] += 1
    want = [(repr(d), links[k], repr(vectors[own.find(k)][0] if d is not None else None), own.find(k) == k or d is None) for k, (d, _, _) in enumerate(vectors)]
    assert sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"]), r["kept"]) for r in got) == sorted(want)


def test_forest_at_depth_finds_planted_pairs(spark):
    """Default trees and overlap, ten levels: pairs at the threshold and above, in doubles, share a leaf."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(24_000, 64)).astype(np.float32)
    want = {}
    for k in range(1500):
        v = x[k].astype(np.float64)
        c = (0.9801, 0.985, 0.995)[k % 3]
        side = rng.normal(size=64)
        side -= side @ v / (v @ v) * v
        side *= np.linalg.norm(v) / np.linalg.norm(side)
        x[12_000 + k] = (c * v + (1 - c * c) ** 0.5 * side).astype(np.float32)
        want[12_000 + k] = k
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(6)
    assert int(np.ceil(np.log2(24_000 / 16))) >= 10
    rows = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame, leaf=16).where("n_links > 0").collect()}
    # no two of the others are near each other
    assert set(rows) <= set(want) | set(want.values()) and all(rows[a]["component_id"] == b for a, b in want.items() if a in rows)
    assert sum(a in rows and rows[a]["n_links"] == 1 for a in want) >= 0.995 * len(want)


@pytest.mark.parametrize("across", [False, True])
def test_leaf_of_near_copies(across):
    """Every pair links: counts are exact, and no pair is kept, whatever leaves the rows share."""
    rng = np.random.default_rng(3)
    n, code = 5000, 1 << embedding_dedup.NODE | 5
    x = (rng.normal(size=64) + 0.01 * rng.normal(size=(n, 64))).astype(np.float32)
    first = rng.integers(0, 4, n)
    codes = [np.array([*([k] if k < 3 else []), code, code + 3], np.int32).tobytes() for k in first]
    block = rng.integers(0, 2, n) if across else np.zeros(n, int)
    copies = rng.integers(1, 4, n)
    table = pa.table({"id": np.arange(n), "copies": copies, "vector": [v.tobytes() for v in x], "codes": codes, "block": block})
    key = [pa.scalar(v) for v in (0, 64, code, 0, int(across))]
    tracemalloc.start()
    got = embedding_dedup._leaf(key, table).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
    links = {a: b for k, a, b in zip(got["kind"], got["a"], got["b"]) if k == 0}
    weight = np.array([[copies[(first == f) & (block == b)].sum() for b in (0, 1)] for f in range(4)])
    for k in range(0, n, 97):
        mine = weight[:, 1 - block[k]] if across else weight.sum(axis=1)
        assert links[k] == mine.sum() - (mine[first[k]] if first[k] < 3 else 0) - (copies[k] if first[k] == 3 and not across else 0)
    assert sorted(a for k, a in zip(got["kind"], got["a"]) if k == 1) == list(range(1, n)) and {b for k, b in zip(got["kind"], got["b"]) if k == 1} == {0}


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, groups, seed):
    rng = random.Random(seed)
    pairs = [(k, k + 1) for k in range(30)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(7, 7), (300, 300), (400, 401), (401, 400), (400, 401)]
    own = groups({x for p in pairs for x in p})
    for a, b in pairs:
        own.join(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    frame = spark.createDataFrame([*pairs, (None, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(frame).collect()} == {(x, own.find(x)) for x in linked}
    assert all(own.find(r["node"]) == own.find(r["root"]) for r in some_roots(frame).collect())
    assert components(frame.where("a IS NULL")).count() == 0
