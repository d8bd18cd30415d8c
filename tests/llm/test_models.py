"""FLAC round trips, the two classifiers on held-out rows, and the pipeline stage by stage."""

import hashlib
import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lockstep.llm import flac, jaccard_join, language_id, mixing, quality, shingles
from lockstep.llm.common import documents, settle, text_bytes

DATA = "/root/testdata/sf0.001"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=1500), st.text("ab é", max_size=900).map(str.encode), st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=3), st.integers(1, 700))), min_size=1, max_size=5))
def test_flac_round_trip(payloads):
    payloads = [flac.padded(p) for p in payloads]
    media = flac.encode(payloads)
    assert [p for p, _, _ in flac.decode(media)] == payloads
    assert flac.encode(payloads[-1:]) == media[-1:]


def test_flac_fields_and_checksums():
    payload = flac.padded(random.Random(1).randbytes(3000) + b"text of letters " * 2000)
    (media,) = flac.encode([payload])
    samples, offsets, total, md5 = flac.seek_points(media)
    assert list(samples) == list(range(0, len(payload), 576)) and total == len(payload)
    assert md5 == hashlib.md5(bytes(b ^ 128 for b in payload)).digest()
    assert all(media[o : o + 4] == flac.HEADER for o in offsets)
    for at in (offsets[0] + 4, offsets[1] + 20, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode([b"RIFF" + media[4:]])
    # one block by its seek point alone
    own, _ = flac.decode_frames(np.frombuffer(media, np.uint8), offsets[3:4], offsets[4:5])
    assert bytes((own[0] & 255).astype(np.uint8) ^ 128) == payload[3 * 576 : 4 * 576]
    assert [flac._number(n) for n in (0, 127, 128, 0x7FF, 0x800, 0xFFFF, 0x10000)] == [chr(n).encode() if n < 0xD800 or n > 0xDFFF else None for n in (0, 127, 128, 0x7FF, 0x800, 0xFFFF, 0x10000)]


def test_flac_decodes_what_the_encoder_never_writes():
    """A verbatim subframe, a fixed predictor of order 3, and other partition orders."""
    x = np.arange(576, dtype=np.int64) ** 2 % 97 - 48

    def frame(subframe):
        head = flac.HEADER + b"\0"
        head += bytes([int(flac.crcs(np.frombuffer(head, np.uint8), np.array([0]), np.array([5]), 8, 7)[0])])
        raw = head + np.packbits(np.array([int(c) for c in subframe])).tobytes()
        return raw + int(flac.crcs(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), 16, 0x8005)[0]).to_bytes(2, "big")

    plain = "00000010" + "".join(f"{v & 255:08b}" for v in x.tolist())
    e = [(v << 1) ^ (v >> 63) for v in np.diff(x, 3).tolist()]
    third = "00010110" + "".join(f"{v & 255:08b}" for v in x[:3].tolist()) + "000000" + f"{5:04b}" + "".join("0" * (v >> 5) + "1" + f"{v & 31:05b}" for v in e)
    frames = [frame(plain), frame(third)]
    data = np.frombuffer(b"".join(frames), np.uint8)
    cuts = np.array([0, len(frames[0]), len(data)])
    got, orders = flac.decode_frames(data, cuts[:-1], cuts[1:])
    assert (got == x).all() and list(orders) == [0, 3]


def test_flac_queries(docs, edges, nothing):
    rows = flac.features(docs).collect()
    want = Counter()
    for r in edges:
        payload = flac.padded((r[1] or "").encode())
        (media,) = flac.encode([payload])
        want[r[0], len((r[1] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    assert Counter(tuple(r)[:-1] for r in rows) == want
    features = {}
    for r in rows:
        assert features.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert flac.features(nothing).count() == 0
    blocks = flac.to_blocks(flac.to_media(docs.where("doc_id = 3"))).orderBy("block").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == flac.padded(edges[3][1].encode()) and [b["sample_offset"] for b in blocks] == [576 * k for k in range(len(blocks))]


def made_up(language, n, rng):
    parts = {"aa": ["ska", "tro", "vil", "den"], "bb": ["qui", "eau", "oux", "gne"], "cc": ["zhi", "xan", "wei", "hao"]}[language]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark, docs, edges, nothing):
    rng = random.Random(5)
    rows = [(k, made_up(x, rng.randint(5, 80), rng), x) for k in range(400) for x in [rng.choice(["aa", "aa", "bb", "cc"])]]
    frame = spark.createDataFrame([*rows, (9000, "12 34", "aa"), (9001, None, "bb"), (9002, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.evaluated(frame).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    held = [k for k, _, _ in rows if got[k]["held_out"]]
    assert sum(got[k]["lang_pred"] == rows[k][2] for k in held) >= 0.99 * len(held)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"] for k in (9000, 9001, 9002))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not any(got[k]["rejected"] for k, _, _ in rows)
    model = language_id.fit(frame)
    strange = pa.array(["ᚠᛇᚻ᛫ᛒᛦᚦ᛫ᚠᚱᚩᚠᚢᚱ᛫ᚠᛁᚱᚪ᛫ᚷᛖᚻᚹᛦᛚᚳᚢᛗ " * 20])
    assert model.predict(strange)[2][0]
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and {type(r["doc_id"]) for r in kept.collect()} <= {int, type(None)}
    assert language_id.evaluated(docs).count() == len(edges) and language_id.evaluated(nothing).count() == 0
    assert language_id.accepted(nothing).count() == 0


def test_statistics_do_not_depend_on_neighbours(edges):
    texts = [r[1] or "" for r in edges]
    together = quality.statistics(pa.array(texts))
    assert np.allclose(together, np.vstack([quality.statistics(pa.array([t])) for t in texts])) and np.isfinite(together).all()
    assert not together[texts.index("")].any()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 5)), min_size=1, max_size=30))
def test_isotonic(points):
    y, w = (np.array(v, float) for v in zip(*points))
    at, fit = quality.isotonic(np.arange(len(y), dtype=float), y, w)
    assert (np.diff(fit) > 0).all() and fit.min() >= 0 and fit.max() <= 1
    assert np.isclose(np.average(y, weights=w), (fit * [sum(w[k] for k in range(len(y)) if np.abs(at - k).argmin() == b) for b in range(len(at))]).sum() / w.sum()) or len(at) > 1


def test_quality(spark, docs, edges, nothing):
    rng = random.Random(6)
    good = lambda: made_up("aa", rng.randint(20, 60), rng).capitalize() + "."
    bad = lambda: rng.choice(["BUY NOW!! " * rng.randint(3, 30), "x " * rng.randint(20, 90), "%%% ### " * 20])
    rows = [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, q int")
    labels = frame.selectExpr("doc_id", "q AS quality", "0 AS toxic").union(spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality.evaluated(frame, labels).collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    assert sum(got[k]["predicted"] == rows[k][2] for k in held) >= 0.98 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    everything = quality.evaluated(docs, labels)
    assert everything.count() == len(edges) and everything.where("score IS NULL").count() == 0
    assert {r["score"] for r in quality.evaluated(docs, labels.where("1 = 0")).collect()} == {0.5}
    assert quality.evaluated(nothing, labels).count() == 0


def test_quality_against_a_plain_computation(spark):
    """Standardised statistics, cosines, the ridge solution and the isotonic fit (max-min of means), each row by itself."""
    rng = random.Random(11)
    rows = [(k, (made_up("aa", rng.randint(3, 60), rng) if k % 2 else "! " * rng.randint(1, 30) + made_up("bb", rng.randint(0, 40), rng)), int((k % 2) ^ (rng.random() < 0.2))) for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    spare = {r["doc_id"]: r["c"] for r in frame.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(quality.CALIBRATE)) == 0).alias("c")).collect()}
    stats = np.vstack([quality.statistics(pa.array([t])) for _, t, _ in rows])
    learn = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    mean, spread = stats[learn].mean(axis=0), stats[learn].std(axis=0)
    draw = np.random.default_rng(quality.SEED)
    w = draw.normal(size=(quality.STATISTICS, quality.FEATURES)) / (quality.WIDTH * np.sqrt(quality.STATISTICS))
    shift = draw.uniform(0, 2 * np.pi, quality.FEATURES)
    features = np.array([[*(np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / np.where(spread > 1e-9, spread, 1), -8, 8) @ w + shift)), 1.0] for x in stats])
    y = np.array([q for _, _, q in rows], float)
    fit, own = [k for k in learn if not spare[k]], [k for k in learn if spare[k]]
    penalty = np.diag([quality.RIDGE] * quality.FEATURES + [1e-6])
    raw = features @ np.linalg.solve(features[fit].T @ features[fit] + penalty, features[fit].T @ y[fit])
    bins = {}
    for k in own:
        bins.setdefault(int(np.floor(raw[k] * quality.BINS)), []).append(k)
    x = np.array([raw[bins[b]].mean() for b in sorted(bins)])
    n = np.array([len(bins[b]) for b in sorted(bins)], float)
    s = np.array([y[bins[b]].sum() for b in sorted(bins)])
    means = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
    value = np.array([max(min(means(a, b) for b in range(k, len(x))) for a in range(k + 1)) for k in range(len(x))])
    levels = sorted(set(np.round(value, 12)))
    at = [np.average(x[np.isclose(value, v)], weights=n[np.isclose(value, v)]) for v in levels]
    want = np.interp(raw, at, levels)
    got = {r["doc_id"]: r["score"] for r in quality.evaluated(frame, frame.select("doc_id", "quality")).collect()}
    assert np.allclose([got[k] for k, _, _ in rows], want, atol=1e-6) and len(levels) > 5


def test_language_against_a_plain_computation(spark):
    """Trigrams by hand, TF-IDF over all learning rows, cosines with the model's centroids, and its thresholds."""
    rng = random.Random(12)
    rows = [(k, made_up(x, rng.randint(1, 50), rng).title() + rng.choice(["", " 12, É!", "  x-y"]), x) for k in range(240) for x in [rng.choice(["aa", "bb", "cc"])]]
    frame = spark.createDataFrame([*rows, (500, "ᚠᛇᚻ ᛒᛦᚦ " * 30, None)], "doc_id long, text string, lang string")
    learn = frame.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    model = language_id.fit(learn)

    def grams(text):
        raw = [32, *(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()), 32]
        found = [a << 16 | b << 8 | c for a, b, c in zip(raw, raw[1:], raw[2:]) if b != 32 or (a != 32 and c != 32)]
        return Counter((g * 0x9E3779B1 >> 15) & (language_id.DIMS - 1) for g in found)

    known = [grams(t) for k, t, x in rows if zlib.crc32(str(k).encode()) % 5]
    seen = Counter(d for g in known for d in g)
    idf = np.array([np.log((1 + len(known)) / (1 + seen[d])) + 0.1 for d in range(language_id.DIMS)])
    assert np.allclose(idf, model.idf) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    assert Counter(model.of.tolist()) == {0: 4, 1: 4, 2: 4}
    got = {r["doc_id"]: r for r in language_id.predict(frame, model).select("doc.doc_id", "lang", "score", "rejected").collect()}
    for k, text, _ in [*rows, (500, "ᚠᛇᚻ ᛒᛦᚦ " * 30, None)]:
        own = grams(text)
        v = np.zeros(language_id.DIMS)
        for d, n in own.items():
            v[d] = (1 + np.log(n)) * idf[d]
        near = model.centroids @ (v / np.linalg.norm(v))
        best = int(near.argmax())
        least = model.least[model.of[best]] * min(1, len(own) / language_id.FULL) ** 0.5
        assert got[k]["lang"] == model.languages[model.of[best]] and abs(got[k]["score"] - max(near[best], 0)) < 1e-5
        assert got[k]["rejected"] == bool(near[best] < least) or abs(near[best] - least) < 1e-5
    assert got[500]["rejected"]


def test_windows_and_memory_of_long_texts(monkeypatch, edges):
    """Statistics, trigrams and sets are the same in whatever windows bytes come, and a long text takes little beside them."""
    texts = pa.array([r[1] or "" for r in edges if len(r[1] or "") < 6000])
    whole = quality.statistics(texts), language_id.counts(texts), shingles.shingle_sets(*text_bytes(texts))
    for step, group in ((7, 3), (64, 50), (1000, 1)):
        for module in (shingles, quality, language_id):
            monkeypatch.setattr(module, "STEP", step)
        monkeypatch.setattr(shingles, "GROUP", group)
        assert np.allclose(quality.statistics(texts), whole[0])
        assert all((a == b).all() for a, b in zip(language_id.counts(texts), whole[1]))
        assert all((a == b).all() for a, b in zip(shingles.shingle_sets(*text_bytes(texts)), whole[2]))
    monkeypatch.undo()
    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, 20 << 20, dtype=np.uint8)
    letters[::6] = 32
    long = pa.array([letters.tobytes().decode()])
    for work, most in ((quality.statistics, 160), (language_id.counts, 100), (lambda t: shingles.shingle_sets(*text_bytes(t)), 130)):
        tracemalloc.start()
        work(long)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most


def test_held_out_labels_and_columns_do_not_matter(spark):
    rows = [(k, "ab cd. " * (k % 9 + 1) if k % 2 else "!!! " * (k % 9 + 1), k % 2) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    flipped = frame.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.evaluated(frame, x.select("doc_id", "quality")).collect())) for x in (frame, flipped))
    assert a == b


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline(spark):
    docs = documents(spark, DATA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(settle(stage(spark, kept[-1], DATA)))
    assert all(d.columns == docs.columns for d in kept[1:-1])
    counts = [d.count() for d in kept]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0.7 * counts[0]
    # each stage against what its operator decides on the stage's own input
    rejected = {r["doc_id"] for r in language_id.evaluated(docs).where("rejected").collect()}
    assert {r["doc_id"] for r in kept[1].collect()} == {r["doc_id"] for r in docs.collect()} - rejected
    lines = Counter()
    seen, texts = set(), {}
    for r in sorted(kept[1].collect(), key=lambda r: r["doc_id"]):
        own, gone = r["text"].split("\n"), set()
        for k in range(len(own) - 2):
            w = tuple(own[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        left = "\n".join(x for k, x in enumerate(own) if k not in gone)
        lines[len(gone) > 0] += 1
        if not gone or left.strip():
            texts[r["doc_id"]] = left
    assert {r["doc_id"]: r["text"] for r in kept[2].collect()} == texts and all(r["n_chars"] == len(r["text"]) for r in kept[2].collect())
    # one document of each component, the least
    component = {r["doc_id"]: r for r in jaccard_join.components_of(kept[2]).collect()}
    assert {r["doc_id"] for r in kept[3].collect()} == {k for k, r in component.items() if r["n_shingles"] == 0 or r["component_id"] == k}
    assert len(component) > kept[3].count()
    # each as often as the mix takes it
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.taken(kept[3]).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in kept[4].collect()) == copies
    pieces = kept[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    times = Counter(r["doc_id"] for r in kept[4].collect())
    assert {r["doc_id"]: r["n"] // r["d"] for r in pieces} == dict(times) and all(r["n"] % r["d"] == 0 for r in pieces)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, kept[5].select("doc_id", "start", "length", "ids_crc32").collect()))
