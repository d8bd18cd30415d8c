"""Removing long repeated byte strings by difference-cover, blockwise suffix sorting.

Names propose, bytes decide.

1. Cover sample. Positions of a text whose residue modulo V lies in a difference cover are sampled.
   Whatever the residues of two positions are, some shift below V puts both on sampled
   positions, so two equal strings of `passage` bytes hold two sampled positions followed by equal
   strings of passage - V + 1 bytes. Only suffixes near a sampled position whose name (a fingerprint) occurs again go on.
2. Names of their first `passage` bytes drop the suffixes that only look alike near the sample. Equal strings have
   equal names, so neither step loses a repeat; what unequal strings of one name add is sorted out next.
3. Suffix buckets. A suffix belongs to the bucket of its anchor, the 8 bytes of the least hash within `passage`
   bytes; suffixes in a row with one anchor travel together, as one piece of text. A task sorts one bucket at a time, by bytes:
   first the next 8 bytes, then, for the long ties, the rank of the cover position that follows, then the string's last bytes.
   Ranks of cover positions are made once per bucket, by doubling. Equal strings lie at equal distances from their anchor, so
   the multiples of 8 from it are a cover there: two suffixes that may be equal reach it by the same shift.
   Neighbours equal to the full depth are repeats. No hash takes part in this decision.
4. Covered bytes are the union of the repeated strings' bytes.

Texts enter chunk by chunk. A chunk sends a name, or a piece, once however often it holds it, so a
string that occurs everywhere costs a row per chunk, not per occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, buckets_for, forget, settle, slices, text_bytes

LENGTH = 400
#: Shorter repeats that are reported, not removed: of over WORDS words, each of three letters and a blank at least.
WORDS = 50
PASSAGE = 4 * (WORDS + 1)
#: Order of the projective plane behind the cover: V = ORDER^2 + ORDER + 1 residues, ORDER + 1 of them sampled.
ORDER = 11
#: Names, and suffixes, that a task sorts at once, about.
BUCKET_NAMES, BUCKET_SUFFIXES = 2_000_000, 500_000
CHUNK_BYTES, CANDIDATE_BYTES = 12 << 20, 4 << 20
STEP = 1 << 19
#: Bytes of an anchor, and distance of the cover positions in a bucket.
WORD = 8
KEYS = "S16"
SENT = "bucket int, chunk long, keys binary, bounds binary, pos binary, fp binary"
FOUND = "chunk long, keys binary, bounds binary, pos binary"
PIECES = "bucket int, chunk long, keys binary, bounds binary, text binary, table binary, at binary"
TEXTS = "key binary, runs binary, repeated binary"
CUT = "key binary, repeated long, passages long, removed long, runs long, sha string, kept binary"
RUNS = "chunk long, keys binary, bounds binary, repeated binary, removed binary"
#: Bytes of a position and of a name as sent; a name's upper bits are its bucket.
POS, NAME = 4, 5
#: Numbers of the fingerprints: seed of the byte table and odd base.
SEED, BASE = 11, 0x9E3779B97F4A7C15


@cache
def difference_cover(order: int = ORDER) -> tuple[int, tuple[int, ...]]:
    """(V, residues) such that every difference modulo V is one of two residues; order is a prime.

    The zeros of a maximal linear recurrence of degree three over the integers modulo the order form
    a perfect difference set.
    """
    v = order * order + order + 1
    for a in range(order):
        for b in range(order):
            for c in range(1, order):
                state, zeros = (0, 0, 1), []
                for k in range(v):
                    if not state[0]:
                        zeros.append(k)
                    state = (state[1], state[2], (a * state[2] + b * state[1] + c * state[0]) % order)
                if len(zeros) == order + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
                    return v, tuple(zeros)
    raise ValueError(f"{order} is not a prime")


@cache
def _tables(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64)

    def powers(x: int, n: int) -> np.ndarray:
        out, k = np.ones(n, np.uint64), 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(x, k, 1 << 64))
            k += m
        return out

    return table, powers(BASE, STEP + length), powers(pow(BASE, -1, 1 << 64), STEP)


def fingerprints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of data[p : p + length] for the ascending positions p."""
    table, up, down = _tables(length)
    out = np.empty(len(at), np.uint64)
    for start in range(0, len(data), STEP):
        lo, hi = np.searchsorted(at, (start, start + STEP))
        if lo == hi:
            continue
        terms = table[data[start : start + STEP + length]]
        sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms * up[: len(terms)], out=sums[1:])
        p = at[lo:hi] - start
        out[lo:hi] = (sums[p + length] - sums[p]) * down[p]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _pick(fp: np.ndarray, buckets: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of x, all first bytes, then all second ones: what hardly changes is together, for the shuffle's compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplaned(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def send(chunk: int, keys: np.ndarray, bounds: np.ndarray, at: np.ndarray, fp: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A chunk's rows: a name once, by bucket, and a row with the texts' keys, bounds and what repeats in the chunk."""
    order = np.argsort(fp, kind="stable")
    same = fp[order[1:]] == fp[order[:-1]]
    again, first = np.zeros(len(fp), bool), np.ones(len(fp), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first[order[1:][same]] = False
    once, bucket = np.flatnonzero(first), _pick(fp, buckets)
    once = once[np.argsort(bucket[once], kind="stable")]
    cuts = np.searchsorted(bucket[once], np.arange(buckets + 1))
    rows = [(chunk % buckets, chunk, keys.tobytes(), bounds.astype(np.int64).tobytes(), _planes(at[again], POS), b"")]
    for b in np.flatnonzero(np.diff(cuts)):
        part = once[cuts[b] : cuts[b + 1]]
        rows.append((int(b), chunk, b"", b"", _planes(at[part], POS), _planes(fp[part], NAME)))
    return _rows(rows, SENT)


def _sorted_names(rows: list[tuple]) -> pa.RecordBatch:
    """Sort one bucket's names; keep the positions of those equal to a neighbour."""
    out = [(c, k, b, p) for c, k, b, p, fp in rows if k]
    rows = [r for r in rows if not r[1]]
    if rows:
        fp = np.concatenate([_unplaned(r[4], NAME) for r in rows])
        order = np.argsort(fp)
        same = fp[order[1:]] == fp[order[:-1]]
        again = np.zeros(len(fp), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        at = 0
        for c, _, _, pos, own in rows:
            mine = again[at : at + len(own) // NAME]
            at += len(mine)
            if mine.any():
                out.append((c, b"", b"", _planes(_unplaned(pos, POS)[mine], POS)))
    return _rows(out, FOUND)


def _by_bucket(work: Callable[[list[tuple]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on the rows of each bucket; rows come sorted by it, and one bucket at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and rows:
                    yield work(rows)
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            yield work(rows)

    return run


def repeated(sent: DataFrame, buckets: int, shape: Callable[[np.ndarray, int], bytes]) -> DataFrame:
    """(key, at, n): by text, what shape makes of its positions with repeated names and its size, and their number; texts without any give no row."""

    def by_text(table: pa.Table) -> pa.Table:
        keys = bounds = None
        parts = []
        for key, bound, pos in zip(table["keys"].to_pylist(), table["bounds"].to_pylist(), table["pos"].to_pylist()):
            if key:
                keys, bounds = np.frombuffer(key, KEYS), np.frombuffer(bound, np.int64)
            parts.append(_unplaned(pos, POS))
        at = np.sort(np.concatenate(parts)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        cuts = np.searchsorted(at, bounds)
        rows, raw = [k for k in range(len(keys)) if cuts[k] < cuts[k + 1]], keys.tobytes()
        return pa.table({
            "key": pa.array([raw[16 * k : 16 * k + 16] for k in rows], pa.binary()),
            "at": pa.array([shape(at[cuts[k] : cuts[k + 1]] - bounds[k], int(bounds[k + 1] - bounds[k])) for k in rows], pa.binary()),
            "n": pa.array([int(cuts[k + 1] - cuts[k]) for k in rows], pa.int64()),
        })

    dealt = sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_by_bucket(_sorted_names), FOUND).groupBy("chunk").applyInArrow(by_text, "key binary, at binary, n long")


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(text_bytes(column)[0].tobytes(), KEYS)


def _cover_sample(docs: DataFrame, passage: int, order: int, buckets: int) -> DataFrame:
    v, residues = difference_cover(order)
    depth, residues = passage - v + 1, np.array(residues)

    def sampled(size: int) -> np.ndarray:
        at = (np.arange(0, size - depth + 1, v)[:, None] + residues).ravel()
        return at[: np.searchsorted(at, size - depth + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part in slices(batches, limit=CHUNK_BYTES):
            data, bounds = text_bytes(part.column(1))
            at = [sampled(int(b - a)) + a for a, b in zip(bounds, bounds[1:])]
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            yield send(chunk, _keys(part.column(0)), bounds, at, fingerprints(data, at, depth), buckets)
            chunk += 1

    return docs.select("key", "text").mapInArrow(run, SENT)


def candidate_starts(sampled: np.ndarray, size: int, passage: int, v: int) -> np.ndarray:
    """Starts of strings that hold a repeated sampled position within the first v bytes."""
    mark = np.zeros(size - passage + 2, np.int32)
    np.add.at(mark, np.clip(sampled - v + 1, 0, len(mark) - 1), 1)
    np.add.at(mark, np.clip(sampled + 1, 0, len(mark) - 1), -1)
    return np.flatnonzero(np.cumsum(mark)[:-1] > 0)


def _names(candidates: DataFrame, passage: int, v: int, buckets: int) -> DataFrame:
    """The names of the candidate suffixes' first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part in slices(batches, limit=CANDIDATE_BYTES):
            data, bounds = text_bytes(part.column(1))
            sampled = part.column(2).to_pylist()
            at = [candidate_starts(np.frombuffer(s, np.uint32).astype(np.int64), int(b - a), passage, v) + a for s, a, b in zip(sampled, bounds, bounds[1:])]
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            yield send(chunk, _keys(part.column(0)), bounds, at, fingerprints(data, at, passage), buckets)
            chunk += 1

    return candidates.select("key", "text", "at").mapInArrow(run, SENT)


def in_a_row(starts: np.ndarray) -> np.ndarray:
    """Runs (first, last + 1) of ascending numbers."""
    new = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + 1]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return np.stack([starts[new], starts[last] + 1], 1).astype(np.int64)


def _word(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number in byte order; behind the end there are zeros."""
    padded = np.concatenate([data, np.zeros(WORD - 1, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(WORD):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def anchors(words: np.ndarray, at: np.ndarray, passage: int) -> np.ndarray:
    """Of each string of `passage` bytes, the first position among those whose 8 bytes have the least hash."""
    mixed = (words ^ words >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    keyed = mixed & np.uint64(0xFFFFFFFF00000000) | np.arange(len(words), dtype=np.uint64)
    size = passage - WORD + 1
    blocks = np.concatenate([keyed, np.full(-len(keyed) % size, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, size)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[at], before[at + size - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _pieces(candidates: DataFrame, passage: int, length: int, buckets: int) -> DataFrame:
    """The suffixes that go on, as pieces of text by bucket; table: size, starts, distance of the anchor and occurrences of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part in slices(batches, limit=CANDIDATE_BYTES):
            data, bounds = text_bytes(part.column(1))
            runs = [np.frombuffer(r, np.int64).reshape(-1, 2) + a for r, a in zip(part.column(2).to_pylist(), bounds)]
            runs = np.concatenate(runs) if runs else np.zeros((0, 2), np.int64)
            size = runs[:, 1] - runs[:, 0]
            at = np.repeat(runs[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())
            words = _word(data)
            anchor = anchors(words, at, passage)
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])])) if len(at) else at
            last = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(at) else at
            begin, stop, anchor = at[first], at[last], anchor[first]
            # a longer string repeats only as far as all its starts go on: what is behind them would only tell equal pieces apart
            end = np.minimum(stop + length, np.repeat(runs[:, 1] - 1 + passage, size)[first])
            named = words[anchor] * np.uint64(0x9E3779B97F4A7C15)
            bucket, raw = _pick(named ^ named >> np.uint64(31), buckets), data.tobytes()
            by: dict[int, dict] = {}
            for b, x, y, n, a in zip(bucket.tolist(), begin.tolist(), end.tolist(), (stop - begin + 1).tolist(), (anchor - begin).tolist()):
                by.setdefault(b, {}).setdefault((raw[x:y], n, a), []).append(x)
            rows = [(chunk % buckets, chunk, _keys(part.column(0)).tobytes(), bounds.tobytes(), b"", b"", b"")]
            for b, own in by.items():
                table = np.array([(len(t), n, a, len(x)) for (t, n, a), x in own.items()], np.uint32)
                rows.append((b, chunk, b"", b"", b"".join(t for t, _, _ in own), table.tobytes(), np.array([p for x in own.values() for p in x], np.uint32).tobytes()))
            yield _rows(rows, PIECES)
            chunk += 1

    return candidates.select("key", "text", "at").mapInArrow(run, PIECES)


def _ranked(*columns: np.ndarray) -> np.ndarray:
    """The rank of each row of the columns in their order; equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, at: np.ndarray, end: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    """For each count, the ranks of the next 8 * count bytes at the cover positions `at`, by position; -1 where they cross end."""
    out = {}

    def pairs(have: np.ndarray, count: int, shift: int) -> np.ndarray:
        ranks, p = np.full(len(words), -1, np.int64), at[at + WORD * count <= end]
        ranks[p] = _ranked(have[p], have[p + WORD * shift])
        return ranks

    count, ranks = 1, np.full(len(words), -1, np.int64)
    p = at[at + WORD <= end]
    ranks[p] = _ranked(words[p])
    while True:
        for c in counts:
            if count <= c < 2 * count:
                out[c] = ranks if c == count else pairs(ranks, c, c - count)
        if 2 * count > max(counts):
            return [out[c] for c in counts]
        count, ranks = 2 * count, pairs(ranks, 2 * count, count)


def ties(words: np.ndarray, at: np.ndarray, shift: np.ndarray, ranks: np.ndarray, depth: int) -> np.ndarray:
    """Whether the string of depth bytes at each suffix is that of another one.

    shift: bytes to the next cover position, whose ranks are of blocks(depth) words. Sorted by the first
    bytes, the rank at the cover position, and what is left behind the ranked bytes.
    """
    reach = shift + WORD * blocks(depth)
    behind = np.where(depth - reach > WORD, words[np.minimum(at + reach, len(words) - 1)], np.uint64(0))
    columns = words[at], ranks[at + shift] * WORD + shift, words[at + depth - WORD], behind
    order = np.lexsort(columns[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    out = np.zeros(len(at), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def blocks(depth: int) -> int:
    """Whole words that a string of depth bytes has behind any shift below a word."""
    return (depth - WORD + 1) // WORD


def _sorted_suffixes(rows: list[tuple], passage: int, length: int) -> pa.RecordBatch:
    """Sort one bucket's suffixes; runs (start, end in the chunk) of the bytes that repeats of either depth cover."""
    out = [(c, k, b, b"", b"") for c, k, b, _, _, _ in rows if k]
    rows = [r for r in rows if not r[1]]
    if not rows:
        return _rows(out, RUNS)
    words = _word(np.frombuffer(b"".join(r[3] for r in rows), np.uint8))
    tables = [np.frombuffer(r[4], np.uint32).reshape(-1, 4).astype(np.int64) for r in rows]
    size, n, anchor, times = np.concatenate(tables).T
    end = np.cumsum(size)
    begin = end - size
    piece = np.repeat(np.arange(len(size)), n)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[piece] + inside
    # cover positions: multiples of a word from the anchor
    first = anchor % WORD
    many = np.maximum((size - first - 1) // WORD + 1, 0)
    own = np.repeat(np.arange(len(size)), many)
    cover = begin[own] + first[own] + WORD * (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many))
    ranks = cover_ranks(words, cover, end[own], [blocks(passage), blocks(length)])
    shift = (anchor[piece] - inside) % WORD
    twice = times[piece] > 1
    short = ties(words, at, shift, ranks[0], passage) | twice
    far = np.flatnonzero(short & (at + length <= end[piece]))
    long = np.zeros(len(at), bool)
    long[far] = ties(words, at[far], shift[far], ranks[1], length) | twice[far]
    places = np.concatenate([np.frombuffer(r[5], np.uint32) for r in rows]).astype(np.int64)
    place_of = np.cumsum(times) - times
    row_of = np.repeat(np.arange(len(rows)), [len(t) for t in tables])
    found = []
    for hit, depth in ((short, passage), (long, length)):
        k = np.flatnonzero(hit)
        head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1] + 1) | (piece[k[1:]] != piece[k[:-1]])])) if len(k) else k
        tail = np.concatenate([head[1:] - 1, [len(k) - 1]]) if len(k) else k
        a, b, p = inside[k[head]], inside[k[tail]] + depth, piece[k[head]]
        copies = times[p]
        where = places[np.repeat(place_of[p] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())]
        runs = np.stack([where + np.repeat(a, copies), where + np.repeat(b, copies)], 1)
        found.append((np.repeat(row_of[p], copies), runs))
    cuts = [np.searchsorted(r, np.arange(len(rows) + 1)) for r, _ in found]
    for k, r in enumerate(rows):
        parts = [runs[c[k] : c[k + 1]].tobytes() for c, (_, runs) in zip(cuts, found)]
        if parts[0]:
            out.append((r[0], b"", b"", *parts))
    return _rows(out, RUNS)


def _merged(runs: np.ndarray) -> np.ndarray:
    if not len(runs):
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], runs[1:, 0] > reach[:-1]]))
    return np.stack([runs[new, 0], reach[np.concatenate([new[1:] - 1, [len(runs) - 1]])]], 1)


def _by_text(table: pa.Table) -> pa.Table:
    """(key, runs, repeated) of a chunk's texts that have a repeat: the runs that go, and those that strings of `passage` bytes cover."""
    keys = bounds = None
    parts: tuple[list, list] = [], []
    for key, bound, short, long in zip(*(table[c].to_pylist() for c in ("keys", "bounds", "repeated", "removed"))):
        if key:
            keys, bounds = np.frombuffer(key, KEYS), np.frombuffer(bound, np.int64)
        parts[0].append(short)
        parts[1].append(long)
    # texts lie end to end in a chunk, and runs of two texts may touch
    short, long = (np.frombuffer(b"".join(p), np.int64).reshape(-1, 2) for p in parts)
    raw, rows = keys.tobytes(), []
    own = [np.searchsorted(bounds, r[:, 0], side="right") - 1 for r in (short, long)]
    order = [np.argsort(o, kind="stable") for o in own]
    cuts = [np.searchsorted(o[q], np.arange(len(bounds))) for o, q in zip(own, order)]
    for k in np.unique(own[0]).tolist():
        mine = [_merged(r[q[c[k] : c[k + 1]]] - bounds[k]) for r, q, c in zip((short, long), order, cuts)]
        rows.append((raw[16 * k : 16 * k + 16], mine[1].tobytes(), mine[0].tobytes()))
    return pa.Table.from_batches([_rows(rows, TEXTS)])


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words of the text that lie in text[start:end] from their first to their last byte."""
    cut = start > 0 and not text[start - 1 : start].isspace() and not text[start : start + 1].isspace()
    cut += end < len(text) and not text[end - 1 : end].isspace() and not text[end : end + 1].isspace()
    return max(len(text[start:end].split()) - cut, 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the covered runs out of each text, and count what repeats."""
    for batch in batches:
        rows = []
        for key, text, runs, repeats in zip(*(batch.column(k).to_pylist() for k in range(4))):
            repeats = np.frombuffer(repeats, np.int64).reshape(-1, 2).tolist()
            n, passages = sum(b - a for a, b in repeats), sum(whole_words(text, a, b) > WORDS for a, b in repeats)
            keep, at, spans = [], 0, np.frombuffer(runs, np.int64).reshape(-1, 2).tolist()
            for a, b in spans:
                keep.append(text[at:a])
                at = b
            left = b"".join([*keep, text[at:]])
            rows.append((key, n, passages, len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        yield _rows(rows, CUT)


def dedup(docs: DataFrame, length: int = LENGTH, passage: int | None = None, order: int = ORDER, keep_text: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, n_repeated, n_passages, and with keep_text the kept bytes.

    A byte is removed if a string of `length` bytes that covers it starts anywhere else too, in any text
    or at another place of its own. n_repeated counts the bytes that such strings of `passage` bytes (PASSAGE, or length if that is less) cover,
    and n_passages the runs of such bytes that hold over WORDS whole words; both are reported only. Strings never cross texts. Null texts are empty; texts shorter than
    `passage` are left alone. Repeated rows and equal texts remove each other wholly where they have `length` bytes. An empty table gives no
    rows. Columns other than doc_id and text are ignored; a null doc_id stays null.
    """
    v, _ = difference_cover(order)
    passage = min(PASSAGE, length) if passage is None else passage
    if not max(v, 2 * WORD - 2) < passage <= length:
        raise ValueError(f"passage must be above {max(v, 2 * WORD - 2)} for a cover of order {order}, and length no less")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("key", F.unhex(F.md5("text")))
    some = keyed.where(F.octet_length("text") >= passage)
    buckets = buckets_for(some)
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    copies = settle(some.groupBy("key").agg(F.count("*").alias("n"), F.min(id_).alias("one")).where("n > 1"))
    marks = repeated(_cover_sample(some, passage, order, buckets), buckets, lambda at, size: at.astype(np.uint32).tobytes())
    marks = settle(marks.groupBy("key").agg(F.any_value("at").alias("at")))
    # of equal texts, one goes on; all others end here
    candidates = some.join(marks, "key").join(copies, "key", "left").where(F.col("n").isNull() | (id_ == F.col("one")))
    candidates = settle(candidates.select("key", "text", "at"))
    # each sampled position stands for v starts at most, each text for no more than its size
    bound = F.least(F.octet_length("at") / 4 * (v / (order + 1)), F.octet_length("text").cast("double"))
    many = candidates.agg(F.coalesce(F.sum(bound), F.lit(0.0))).first()[0]
    dealt = max(buckets, int(many // BUCKET_NAMES) + 1)
    named = settle(repeated(_names(candidates, passage, v, dealt), dealt, lambda at, size: in_a_row(at).tobytes()))
    many = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = max(buckets, int(many // BUCKET_SUFFIXES) + 1)
    starts = named.groupBy("key").agg(F.any_value("at").alias("at"))
    left = settle(candidates.select("key", "text").join(starts, "key"))
    forget(marks, candidates, named)
    pieces = _pieces(left, passage, length, dealt).repartitionById(dealt, "bucket").sortWithinPartitions("bucket")

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        return _sorted_suffixes(rows, passage, length)

    runs = settle(pieces.mapInArrow(_by_bucket(sort), RUNS).groupBy("chunk").applyInArrow(_by_text, TEXTS))
    once = runs.groupBy("key").agg(F.any_value("runs").alias("runs"), F.any_value("repeated").alias("repeated"))
    cut = left.select("key", "text").join(once, "key").mapInArrow(_cut, CUT)
    cut = settle((cut if keep_text else cut.drop("kept")).dropDuplicates(["key"]))
    forget(left, runs)
    base = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("__sha"), "text")
    both = base.join(cut, "key", "left").join(copies.select("key", F.lit(True).alias("__copied")), "key", "left")
    copied = F.col("__copied").isNotNull()
    whole = copied & (F.col("n_bytes") >= length)
    words = F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN))
    return both.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "__sha")).alias("kept_sha256"),
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("repeated", F.lit(0))).cast("long").alias("n_repeated"),
        F.when(copied, (words > WORDS).cast("long")).otherwise(F.coalesce("passages", F.lit(0))).cast("long").alias("n_passages"),
        *[F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "text")).alias("kept")][: int(keep_text)],
    )


def _oracle(length: int = LENGTH, passage: int = PASSAGE) -> str:
    """Every string of either size is cut out and counted: for small tables with an id for each row."""

    def runs(size: int) -> str:
        return f"""
starts{size} AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 2 * {size})) AS m FROM (SELECT doc_id, x, unnest(range(0, bytes - {size} + 1)) AS p FROM texts))
  QUALIFY count(*) OVER (PARTITION BY m) > 1),
runs{size} AS MATERIALIZED (
  SELECT doc_id, min(p) AS a, max(p) + {size} AS e FROM (
    SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (
      SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {size} THEN 1 ELSE 0 END AS new FROM starts{size}))
  GROUP BY doc_id, k)"""

    return f"""
WITH texts AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents),{runs(length)},{runs(passage)},
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * back + 1, 2 * (a - back)), '' ORDER BY a, real DESC) AS h, sum(e - a) FILTER (WHERE e > a AND real) AS n_removed, count(*) FILTER (WHERE real) AS n_spans FROM (
    SELECT t.doc_id, x, a, e, real, coalesce(lag(e) OVER (PARTITION BY t.doc_id ORDER BY a, real DESC), 0) AS back FROM texts t JOIN (
      SELECT doc_id, a, e, true AS real FROM runs{length} UNION ALL SELECT doc_id, bytes, bytes, false FROM texts) r ON t.doc_id = r.doc_id)
  GROUP BY doc_id),
marks AS MATERIALIZED (
  SELECT doc_id, p, space, lag(space) OVER w AS before, lead(space) OVER w AS after FROM (
    SELECT doc_id, p, substr(x, 2 * p + 1, 2) IN ('20', '09', '0A', '0B', '0C', '0D') AS space FROM (SELECT doc_id, x, unnest(range(0, bytes)) AS p FROM texts SEMI JOIN runs{passage} USING (doc_id)))
  WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
words AS (
  SELECT doc_id, s, p + 1 AS e FROM (
    SELECT doc_id, p, last, max(CASE WHEN first THEN p END) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM (
      SELECT doc_id, p, NOT space AND coalesce(before, true) AS first, NOT space AND coalesce(after, true) AS last FROM marks))
  WHERE last),
long AS (
  SELECT doc_id, count(*) AS n FROM (SELECT r.doc_id, a FROM runs{passage} r JOIN words w ON w.doc_id = r.doc_id AND w.s >= r.a AND w.e <= r.e GROUP BY r.doc_id, a HAVING count(*) > {WORDS}) GROUP BY doc_id),
wide AS (SELECT doc_id, sum(e - a) AS n FROM runs{passage} GROUP BY doc_id)
SELECT t.doc_id, CAST(bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(h, ''))) AS kept_sha256, CAST(coalesce(wide.n, 0) AS BIGINT) AS n_repeated, CAST(coalesce(long.n, 0) AS BIGINT) AS n_passages
FROM texts t JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN wide ON wide.doc_id = t.doc_id LEFT JOIN long ON long.doc_id = t.doc_id
"""


ORACLE = _oracle()
