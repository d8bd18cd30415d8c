"""Word shingles of many texts at once, as 64-bit names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

WORDS = 5
#: Bytes, or numbers, that are worked on at once; words of texts that are.
STEP, GROUP = 1 << 20, 1 << 20
#: The bytes that end a word, and odd multipliers by place in a shingle.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
PLACES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
BASE = 0x2545F4914F6CDD1D | 1


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    table = np.random.default_rng(71).integers(0, 1 << 64, 256, dtype=np.uint64)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    return table, space


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        out, k = np.ones(n, np.uint64), 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(x, k, 1 << 64))
            k += m
        return out

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """x mixed in place."""
    for at in range(0, len(x), STEP):
        y = x[at : at + STEP]
        y ^= y >> np.uint64(32)
        y *= np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(32)
    return x


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, bounds) of the words of texts laid end to end; A-Z count as a-z.

    The bytes are worked on in windows of STEP, so that what is held beside the result does not grow with a text. A word's
    name is a sum over its bytes; one that a window cuts gets its sum from several.
    """
    table, space = _letters()
    up, down = _powers(STEP)
    n, parts, have = len(data), [], 0
    cuts = np.zeros(len(bounds), np.int64)  # words that begin before each bound
    carried, begun = 0, -1  # of a word that goes on into the next window: its sum so far, and where it begins
    for at in range(0, n, STEP):
        stop = min(at + STEP, n)
        blank = space[data[max(at - 1, 0) : min(stop + 1, n)]]
        lead = int(at > 0)
        own = ~blank[lead : lead + stop - at]
        edge = np.zeros(stop - at + 1, bool)
        lo, hi = np.searchsorted(bounds, (at, stop + 1))
        edge[bounds[lo:hi] - at] = True
        begin, end = own.copy(), own.copy()
        begin[lead == 0 :] &= (blank[: stop - at] if lead else blank[: stop - at - 1]) | edge[lead == 0 : stop - at]
        after = blank[lead + 1 :]
        end[: len(after)] &= after | edge[1 : len(after) + 1]
        first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
        lo, hi = np.searchsorted(bounds, (at, stop))
        cuts[lo:hi] = have + np.searchsorted(first, bounds[lo:hi] - at)
        have += len(first)
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(table[data[at:stop]] * up[: stop - at], out=sums[1:])
        if begun >= 0:
            ends = int(last[0]) if len(last) else stop - at
            carried = (carried + int(sums[ends]) * pow(BASE, at - begun, 1 << 64)) % (1 << 64)
            if len(last):
                parts.append(np.array([carried], np.uint64))
                last, begun = last[1:], -1
        if len(first) > len(last):
            begun = at + int(first[-1])
            carried = (int(sums[-1]) - int(sums[first[-1]])) * int(down[first[-1]]) % (1 << 64)
            first = first[:-1]
        if len(first):
            parts.append((sums[last] - sums[first]) * down[first])
    cuts[np.searchsorted(bounds, n) :] = have
    return mixed(np.concatenate(parts) if parts else np.zeros(0, np.uint64)), cuts


def _one_set(word: np.ndarray) -> np.ndarray:
    """shingle_sets of one text of WORDS words or more, without a number per shingle and word."""
    n = len(word) - WORDS + 1
    names = np.zeros(n, np.uint64)
    for at in range(0, n, STEP):
        stop = min(at + STEP, n)
        for k in range(WORDS):
            names[at:stop] += word[at + k : stop + k] * np.uint64(PLACES[k])
    mixed(names).sort()
    new = np.ones(n, bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    return names[new]


def groups(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of texts of about GROUP words, bounds at; a text that is larger is alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + GROUP, side="right")) - 1)
        yield first, last
        first = last


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, bounds): each text's distinct shingles in ascending order.

    A text of fewer than WORDS words has one shingle, all its words; one without words has none.
    """
    return sets_of_words(*words(data, bounds))


def sets_of_words(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in groups(at):
        own = word[at[a] : at[b]]
        if b - a == 1 and len(own) > max(GROUP, WORDS):
            names.append(_one_set(own))
            sizes.append(np.array([len(names[-1])]))
        else:
            found, cuts = _sets(own, at[a : b + 1] - at[a])
            names.append(found)
            sizes.append(np.diff(cuts))
    return (names[1] if len(names) == 2 else np.concatenate(names)), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _sets(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(at)
    size = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    ends = np.cumsum(size)
    text = np.repeat(np.arange(len(count)), size)
    first = at[text] + np.arange(len(text)) - (ends - size)[text]
    names = np.zeros(len(text), np.uint64)
    short = count[text] < WORDS
    for k in range(WORDS):
        inside = first + k < at[text + 1] if short.any() else slice(None)
        names[inside] += word[(first + k)[inside]] * np.uint64(PLACES[k])
    names[short] += np.uint64(PLACES[WORDS]) * count[text][short].astype(np.uint64)
    names = mixed(names)
    for a, b in zip(ends - size, ends):
        names[a:b].sort()
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    return names[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(count)))]).astype(np.int64)
