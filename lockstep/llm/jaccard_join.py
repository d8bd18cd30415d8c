"""Exact Jaccard join of documents on sets of word shingles, with set-relation skipping.

1. Shingles are counted over all documents; those in many of them go to the end of the global order,
   so that a document's prefix holds its rare shingles.
2. Two linked sets share a shingle in their prefixes. The index is one list per prefix shingle, sorted by
   set size. An entry's position in its prefix says how large a set it can link with at most (reach): the block of the
   list behind that size is skipped as a whole, and single entries before it by their own position.
3. Answers are derived, not recomputed. A set is first compared with the one that shares most lists with
   it. Then only pairs are compared that no chain of answers has put together already: a set
   inherits what is known of a highly similar set. Where a set is compared with several similar ones, only the first overlap is counted in
   full; the others follow from it by the few shingles in which they differ (overlaps). In lists of more than LIST sets each is compared
   with the heads of the near size classes first, and pairs are looked at only where they are still apart after that.

Equal texts are one node from the start. Nodes are 64-bit hashes of texts; where a second hash tells two texts of one
node apart, all but one get a node of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, buckets_for, forget, looked_up, scratch, settle, slices, text_bytes
from .components import components, some_roots
from .shingles import shingle_sets

#: Linked when PER_CENT[1] * intersection >= PER_CENT[0] * union.
PER_CENT = (75, 100)
#: Shingles in this many sets at least may go to the end of the order, and so many of them at most (which bounds the broadcast).
FREQUENT, MOST_FREQUENT = 32, 1 << 20
#: Lists of up to so many sets are compared pair by pair.
LIST = 64
#: Lists of shingles in 2 to this power of sets, those among the MOST_FREQUENT, are not in one task: their members are spread, and joined with their heads.
SPREAD = 14
CHUNK_BYTES, PART_BYTES = 12 << 20, 1 << 20
COUNTED = "bucket int, tokens binary, many binary, times binary, nodes binary, sizes binary"
INDEXED = "bucket int, width int, tokens binary, docs binary, places binary, nodes binary, sizes binary"


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, names, bounds) of the different texts of about CHUNK_BYTES of input at a time; columns node, text."""
    nodes, names, sizes, seen, have = [], [], [], set(), 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(nodes, np.int64), np.concatenate(names), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    for part in slices(batches, limit=PART_BYTES):
        own = part.column(0).to_pylist()
        new = [k for k, node in enumerate(own) if node not in seen and not seen.add(node)]
        text = part.column(1) if len(new) == len(own) else part.column(1).take(pa.array(new))
        data, bounds = text_bytes(text)
        name, at = shingle_sets(data, bounds)
        nodes += [own[k] for k in new]
        names.append(name)
        sizes.append(np.diff(at))
        have += len(data)
        if have >= CHUNK_BYTES:
            yield out()
            nodes, names, sizes, have = [], [], [], 0
            seen.clear()
    if nodes:
        yield out()


def _count(docs: DataFrame, buckets: int, often: int = FREQUENT) -> DataFrame:
    """kind 0: (shingle's short name, sets that hold it) of the frequent; kind 1: (node, its set's size)."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, names, bounds in _chunks(batches):
            tokens = np.sort(names)
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([first, [len(tokens)]])).astype(np.uint32)
            tokens = tokens[first]
            cuts = np.searchsorted(_bucket(tokens, buckets), np.arange(buckets + 1))
            low = tokens.astype(np.uint32)
            rows = [(int(nodes[0]) % buckets, b"", b"", b"", nodes.tobytes(), np.diff(bounds).astype(np.uint32).tobytes())]
            for b in np.flatnonzero(np.diff(cuts)):
                t, n = low[cuts[b] : cuts[b + 1]], times[cuts[b] : cuts[b + 1]]
                rows.append((int(b), t[n == 1].tobytes(), t[n > 1].tobytes(), n[n > 1].tobytes(), b"", b""))
            yield _batch(rows, COUNTED)

    def summed(rows: list[tuple]) -> pa.RecordBatch:
        one = np.frombuffer(b"".join(r[1] for r in rows), np.uint32)
        many = np.frombuffer(b"".join(r[2] for r in rows), np.uint32)
        weight = np.concatenate([np.ones(len(one), np.int64), np.frombuffer(b"".join(r[3] for r in rows), np.uint32).astype(np.int64)])
        token = np.concatenate([one, many])
        order = np.argsort(token, kind="stable")
        token, weight = token[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, first) if len(first) else weight
        keep = total >= often
        a = (np.int64(rows[0][0]) << 32) | token[first][keep].astype(np.int64)
        nodes = np.frombuffer(b"".join(r[4] for r in rows), np.int64)
        sizes = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).astype(np.int64)
        kind = np.repeat(np.array([0, 1], np.int32), [len(a), len(nodes)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([a, nodes])), pa.array(np.concatenate([total[keep], sizes]))], ["kind", "a", "n"])

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (summed(rows) for rows in _runs(batches))

    dealt = docs.select("node", "text").mapInArrow(sent, COUNTED).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(by_bucket, "kind int, a long, n long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that come sorted by their first column, a list for each of its values."""
    rows: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if rows and rows[-1][0] != row[0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Short names, ascending, and levels of at most MOST_FREQUENT shingles, those in most sets."""
    level = F.floor(F.log2("n")).cast("int")
    have, least = 0, None
    for row in counts.where("kind = 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if (have := have + row["count"]) > MOST_FREQUENT:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    found = counts.where("kind = 0").where(level >= least).select("a", level.alias("level")).toArrow()
    names, levels = found["a"].to_numpy(), found["level"].to_numpy().astype(np.int8)
    order = np.argsort(names)
    return names[order], levels[order]


def prefix_size(size: np.ndarray) -> np.ndarray:
    """So many of a set's shingles that a set which links with it holds one of them."""
    need = -(-size * PER_CENT[0] // PER_CENT[1])
    return np.where(size > 0, size - need + 1, 0)


def _index(docs: DataFrame, buckets: int, frequent, longest: int = LIST, spread: int = SPREAD) -> DataFrame:
    """The index, walked: what listed gives; frequent is a broadcast of names and levels."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, levels = frequent.value
        hint = np.zeros(1 << 22, bool)
        hint[often & (len(hint) - 1)] = True
        for nodes, names, bounds in _chunks(batches):
            level = np.zeros(len(names), np.int8)
            if len(often):
                near = np.flatnonzero(hint[(names & np.uint64(len(hint) - 1)).astype(np.int64)])
                short = (_bucket(names[near], buckets) << 32) | (names[near] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                at = np.minimum(np.searchsorted(often, short), len(often) - 1)
                hit = often[at] == short
                level[near[hit]] = levels[at[hit]]
                for k in np.unique(np.searchsorted(bounds, near[hit], side="right") - 1):
                    a, b = bounds[k], bounds[k + 1]
                    order = np.argsort(level[a:b], kind="stable")
                    names[a:b], level[a:b] = names[a:b][order], level[a:b][order]
            size = np.diff(bounds)
            take = prefix_size(size)
            doc = np.repeat(np.arange(len(nodes)), take)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take)
            token = names[bounds[doc] + place]
            spread_out = level[bounds[doc] + place] >= spread
            # slots 0 to buckets: lists by shingle; above: spread by chunk
            bucket = np.where(spread_out, buckets + int(nodes[0]) % buckets, _bucket(token, buckets))
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 15 else bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[b] : cuts[b + 1]]
                own, inside = np.unique(doc[part], return_inverse=True)
                width = 2 if max(len(own), int(place[part].max())) < 1 << 16 else 4
                kind = np.uint16 if width == 2 else np.uint32
                rows.append((int(b) % buckets, width if b < buckets else -width, token[part].tobytes(), inside.astype(kind).tobytes(), place[part].astype(kind).tobytes(), nodes[own].tobytes(), size[own].astype(np.uint32).tobytes()))
            if rows:
                yield _batch(rows, INDEXED)

    dealt = docs.select("node", "text").mapInArrow(sent, INDEXED).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (listed(rows, longest) for rows in _runs(batches))

    return dealt.mapInArrow(by_bucket, "kind int, a long, b long, n int, place int")


def can_link(size: np.ndarray, other: np.ndarray, place: np.ndarray | int = 0, place2: np.ndarray | int = 0) -> np.ndarray:
    """Whether sets of these sizes (size <= other) whose first common shingle is at these places can link."""
    t, h = PER_CENT
    most = np.minimum(size - place, other - place2)
    return (other * t <= size * h) & (most * (t + h) >= t * (size + other))


def reach(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest set that a set of this size, as the smaller one, can link with if their first common shingle is at its place."""
    t, h = PER_CENT
    return ((size - place) * (t + h) - t * size) // t


def _entries(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, node, size, place) of index rows."""
    token, node, size, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, width, tokens, docs, places, nodes, sizes in rows:
        kind = np.uint16 if abs(width) == 2 else np.uint32
        own = np.frombuffer(docs, kind)
        token.append(np.frombuffer(tokens, np.uint64))
        node.append(np.frombuffer(nodes, np.int64)[own])
        size.append(np.frombuffer(sizes, np.uint32)[own].astype(np.int64))
        place.append(np.frombuffer(places, kind).astype(np.int64))
    return np.concatenate(token), np.concatenate(node), np.concatenate(size), np.concatenate(place)


def listed(rows: list[tuple], longest: int = LIST) -> pa.RecordBatch:
    """A bucket's lists walked: kind 0, candidate pairs (a, b); kind 1, members (a: list, b: node, n: size, place) of long
    lists; kind 2, the same of lists that are spread, whose pairs come later."""
    apart, together = _entries([r for r in rows if r[1] < 0]), _entries([r for r in rows if r[1] > 0])
    token, node, size, place = together
    order = np.argsort(token)
    same = token[order[1:]] == token[order[:-1]]
    shared = np.zeros(len(token), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    token, node, size, place = token[shared], node[shared], size[shared], place[shared]
    order = np.lexsort((node, size, token))
    token, node, size, place = token[order], node[order], size[order], place[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, size, place = token[new], node[new], size[new], place[new]
    n = len(token)
    head = np.ones(n, bool)
    head[1:] = token[1:] != token[:-1]
    start = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    length = np.diff(np.concatenate([start, [n]]))
    long = length[group] > longest
    left, right = [], []
    most = reach(size, place)
    i, step = np.flatnonzero(~long & (most >= size)), 1
    while len(i):
        i = i[i + step < n]
        j = i + step
        inside = (group[j] == group[i]) & (size[j] <= most[i])
        i, j = i[inside], j[inside]  # sizes ascend: behind the first that is out of reach, a list's rest is skipped
        ok = can_link(size[i], size[j], place[i], place[j])
        left.append(node[i[ok]])
        right.append(node[j[ok]])
        step += 1
    member = np.flatnonzero(long)
    # the head of a size class is the set with the fewest shingles rarer than the list's: the nearest to what all share
    classes = (np.log(size[member]) / np.log(PER_CENT[1] / PER_CENT[0])).astype(np.int64)
    key = group[member] * 1024 + classes + 1
    order = np.lexsort((place[member], key))
    first = order[np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))] if len(member) else member
    for near in (-1, 0, 1):
        at = np.searchsorted(key[first], key + near) if len(first) else member
        at = np.minimum(at, len(first) - 1)
        ok = key[first][at] == key + near if len(first) else np.zeros(0, bool)
        a, b = member[first[at[ok]]], member[ok]
        small, large = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        ok = (a != b) & can_link(size[small], size[large], place[small], place[large])
        left.append(node[a[ok]])
        right.append(node[b[ok]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    kind = np.repeat(np.array([0, 1, 2], np.int32), [len(a), len(member), len(apart[0])])
    lists = np.concatenate([a, token[member].view(np.int64), apart[0].view(np.int64)])
    none = np.zeros(len(a), np.int32)
    sizes, places = (np.concatenate([none, v[member].astype(np.int32), w.astype(np.int32)]) for v, w in ((size, apart[2]), (place, apart[3])))
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(lists), pa.array(np.concatenate([b, node[member], apart[1]])), pa.array(sizes), pa.array(places)], ["kind", "a", "b", "n", "place"])


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The size of the intersection of sets x[k] and y[k] for each k.

    For each y the first x is counted in full, and what it holds of y is kept; a later x that differs from it in few
    shingles gets its answer from that one's by the difference, which is made once for all y.
    """
    out = np.zeros(len(x), np.int64)
    order, apart, base, own = np.argsort(y, kind="stable"), {}, -1, None
    for k in order.tolist():
        a, b = int(x[k]), int(y[k])
        if b != own:
            own, base, held = b, a, np.isin(sets[a], sets[b], assume_unique=True)
            out[k] = full = int(held.sum())
            continue
        if (base, a) not in apart:
            shared = np.isin(sets[base], sets[a], assume_unique=True)
            few = (~shared).sum() * 2 < len(sets[a]) and (len(sets[a]) - shared.sum()) * 2 < len(sets[a])
            apart[base, a] = (np.flatnonzero(~shared), np.setdiff1d(sets[a], sets[base], assume_unique=True)) if few else None
        if (differ := apart[base, a]) is None:
            out[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        else:
            out[k] = full - int(held[differ[0]].sum()) + int(np.isin(differ[1], sets[b], assume_unique=True).sum())
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text of a, text of b) whose sets link; in a batch each text's set is made once."""
    for batch in batches:
        for part in slices(slices(iter([batch]), "text_a", PART_BYTES), "text_b", PART_BYTES):
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            both = np.concatenate([a, b])
            own, first, inside = np.unique(both, return_index=True, return_inverse=True)
            texts = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(first))
            data, bounds = text_bytes(texts)
            names, at = shingle_sets(data, bounds)
            sets = [names[x:y] for x, y in zip(at, at[1:])]
            x, y = inside[: len(a)], inside[len(a) :]
            common = overlaps(sets, x, y)
            size = np.diff(at)
            union = size[x] + size[y] - common
            ok = (common * PER_CENT[1] >= union * PER_CENT[0]) & (common > 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(first, "a").join(second, "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends no chain of links joins yet."""
    one, two = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    rooted = pairs.join(one, "a", "left").join(two, "b", "left")
    return rooted.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _can(one: str, two: str) -> str:
    """can_link in SQL, of members one and two of a list."""
    t, h = PER_CENT
    return (
        f"greatest({one}.n, {two}.n) * {t}L <= least({one}.n, {two}.n) * {h}L AND "
        f"least({one}.n - {one}.place, {two}.n - {two}.place) * {t + h}L >= {t}L * ({one}.n + {two}.n)"
    )


def _with_heads(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of spread lists' members and the heads of their own and the next size classes."""
    t, h = PER_CENT
    classed = members.withColumn("class", F.expr(f"int(ln(n) / ln({h} / {t}))"))
    heads = classed.groupBy("a", "class").agg(F.min(F.struct("place", "b", "n")).alias("m")).select("a", "class", "m.b", "m.n", "m.place")
    near = classed.withColumn("near", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    both = near.alias("x").join(heads.alias("y"), F.expr(f"x.a = y.a AND x.near = y.class AND x.b <> y.b AND {_can('x', 'y')}"))
    return both.select(F.expr("least(x.b, y.b)").alias("a"), F.expr("greatest(x.b, y.b)").alias("b"))


def _across(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of a list's members that lie in different components and can link; rooted: members with their root.

    Of each list, all that lie outside its largest component meet the list, by the size classes that can link: a list is
    as many keys as it has classes. Pairs that cannot link don't leave the join.
    """
    t, h = PER_CENT
    rooted = rooted.withColumn("class", F.expr(f"int(ln(n) / ln({h} / {t}))"))
    sizes = rooted.groupBy("a", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("a").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("a", F.col("m.root").alias("largest"))
    split = rooted.join(largest, "a")
    rest = split.where("root <> largest").withColumn("near", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    both = rest.alias("x").join(split.alias("y"), F.expr(f"x.a = y.a AND x.near = y.class AND x.root <> y.root AND {_can('x', 'y')}"))
    return both.select(F.expr("least(x.b, y.b)").alias("a"), F.expr("greatest(x.b, y.b)").alias("b")).distinct()


def links(docs: DataFrame, often: int = FREQUENT, longest: int = LIST, spread: int = SPREAD) -> DataFrame:
    """(node, n, root), settled, of all texts; docs: node, text.

    n is the number of shingles, root the least node of the component, which may be the node itself; often, longest and spread are FREQUENT, LIST and SPREAD.
    """
    spark = docs.sparkSession
    buckets = buckets_for(docs)
    counts = settle(_count(docs, buckets, often))
    frequent = spark.sparkContext.broadcast(_frequent(counts))
    found = settle(_index(docs, buckets, frequent, longest, spread))
    apart = found.where("kind = 2").groupBy("a", "b").agg(F.first("n").alias("n"), F.first("place").alias("place"))
    members = found.where("kind = 1").select("a", "b", "n", "place").union(apart)
    pairs = settle(found.where("kind = 0").select("a", "b").union(_with_heads(apart)).groupBy("a", "b").agg(F.count("*").alias("hits")))
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("b")).distinct()
    texts = docs.groupBy("node").agg(F.any_value("text").alias("text")).join(involved, "node", "left_semi")
    texts = settle(texts)
    # the nearest of each first
    both = pairs.select("a", "b", "hits").union(pairs.select("b", "a", "hits"))
    nearest = both.groupBy("a").agg(F.max(F.struct("hits", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    nearest = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = settle(compare(nearest, texts))
    # then the pairs that those answers leave open
    known = some_roots(first)
    rest = settle(compare(_apart(pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti"), known), texts))
    labels = components(first.union(rest))
    # then the pairs of long lists that are still open
    rooted = settle(members.join(labels, F.col("b") == F.col("node"), "left").select("a", "b", "n", "place", F.coalesce("root", "b").alias("root")))
    open_ = settle(_across(rooted))
    done = [found, pairs, texts, first, known, rest, rooted, open_]
    if not open_.isEmpty():
        more = settle(compare(open_.join(pairs, ["a", "b"], "left_anti"), texts))
        done += [labels, more]
        labels = components(first.union(rest).union(more))
    sizes = counts.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.max("n").alias("n"))
    out = settle(sizes.join(labels, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")))
    forget(counts, labels, *done)
    return out


def with_nodes(docs: DataFrame) -> DataFrame:
    """docs (with a text that is not null) with node, a number for each different text."""
    texts = docs.withColumn("node", F.xxhash64("text")).withColumn("__other", F.xxhash64(F.lit(1), "text"))
    shared = texts.groupBy("node").agg(F.min("__other").alias("__least"), F.max("__other").alias("__most")).where("__least <> __most")
    shared = settle(shared.select(F.col("node").alias("__shared"), "__least"))
    own = texts.join(looked_up(shared), F.col("node") == F.col("__shared"), "left")
    node = F.when(F.col("__other") != F.col("__least"), F.xxhash64(F.lit(2), "text")).otherwise(F.col("node"))
    return own.withColumn("node", node).drop("__other", "__shared", "__least")


def _rooted(docs: DataFrame, often: int, longest: int, spread: int) -> DataFrame:
    """(doc_id, node, n, root), settled, for each row of docs: its text's node and number of shingles, and the least node of its component."""
    with scratch() as keep:
        texts = with_nodes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
        found = links(texts.select("node", "text"), often, longest, spread)
        # both sides are plain shuffles: many rows of one text are split
        return keep(settle(texts.select("doc_id", "node").join(found, "node")))


def components_of(docs: DataFrame, often: int = FREQUENT, longest: int = LIST, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text).

    component_id is the least doc_id that links reach. Null and empty texts and texts without a word have the
    empty set and link with nothing; their component is their own doc_id. Equal texts link. Repeated rows
    give a row each. An empty table gives no rows. Columns other than doc_id and text are ignored. A null
    doc_id counts for a component only where it has no other.
    """
    rows = _rooted(docs, often, longest, spread)
    least = settle(rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")))
    out = rows.join(looked_up(least), "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the least of their component; all rows whose texts link with none stay.

    Rows that share a doc_id stay or go together.
    """
    least = components_of(docs)
    kept = least.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def one_row_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, whatever its ids; all rows whose texts have no word stay.

    The row of the least doc_id stays, nulls last; among texts of one doc_id that of the least hash; and of rows equal
    in doc_id and text the least by all columns. An empty table stays empty.
    """
    key = lambda node: F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), node.alias("node"))
    rows = _rooted(docs, FREQUENT, LIST, SPREAD).where("n > 0")
    kept = rows.groupBy("root").agg(F.min(key(F.col("node"))).alias("__key")).select("__key")
    word = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    keyed = with_nodes(docs.where(word).select(F.struct(*docs.columns).alias("doc"), "doc_id", "text"))
    keyed = keyed.select("doc", key(F.col("node")).alias("__key"))
    # dealt by the key once, for the join and for equal rows
    found = keyed.join(kept, "__key", "left_semi").groupBy("__key").agg(F.min("doc").alias("doc"))
    return found.select("doc.*").union(docs.where(~word))


#: Every pair that shares a shingle is looked at: for small tables.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
reached AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reached.d, links.y FROM reached JOIN links ON reached.r = links.x)
SELECT d AS doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reached LEFT JOIN sizes ON sizes.doc_id = d GROUP BY d
"""
