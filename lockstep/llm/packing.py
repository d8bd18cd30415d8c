"""Sum-of-squares online packing of token sequences into windows.

Every task packs the documents of its own input split as they come: a document's
full windows stand alone, and its remainder goes to the fill level h that keeps the
sum over levels of N(h)^2 least, N(h) being the number of open windows filled to h.
N is the level array; a stack per level names the windows. There is no shuffle, and a
task that is run again reads the same split and so makes the same sequences.

However many windows are open, none is touched but by that rule until the task ends: open windows
hold their ids in two bytes each where the vocabulary allows it, which is less than the text of the task's own split.
Then the open windows are closed out: the emptiest windows are cut up to fill the gaps of the
fullest. What is left of the task's last window is cut into sequences whose sizes
are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices

WINDOW = 2048
END_ID = 1
#: Memoised words of a worker; the older half goes when they are reached.
MEMO_WORDS = 400_000
#: Characters that the fast path knows: for these, lower-casing is one to one and nothing is recomposed.
PLAIN = r"^[\x00-\x08\x0e-\x1b\x20-\x7e\n\xa1-\xac\xae-\xb4\xb6-\xff]*$"
CORE = r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of whole texts by the tokenizers library, each distinct word looked up once.

    White space always ends a token of this vocabulary and is dropped, so the ids of a
    text are those of its words in a row. Texts with characters outside PLAIN, or that hold a
    special token's name, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.core = re.compile(CORE).fullmatch
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.puncts: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def word(self, word: str) -> bytes:
        if (found := self.older.get(word)) is None:
            if match := self.core(word):
                letters, tail = match.groups()
                if (end := self.puncts.get(tail)) is None:
                    end = self.puncts[tail] = self.whole(tail).tobytes()
                plain = letters if letters.isascii() else self.bytes_of.pre_tokenize_str(letters)[0][0]
                found = np.array([x.id for x in self.model.tokenize(plain)], "<u4").tobytes() + end
            else:
                found = self.whole(word).tobytes()
        if len(self.memo) >= MEMO_WORDS // 2:
            self.older, self.memo = self.memo, {}
            self.puncts = {"": b""}
        self.memo[word] = found
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the n + 1 bounds of the texts."""
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|")))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        fast = pc.if_else(plain, texts, "") if len(odd) else texts
        words = pc.split_pattern(pc.replace_substring(pc.utf8_lower(fast), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        memo, word = self.memo, self.word
        known = [memo.get(w) or (word(w) if w else b"") for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        vocabulary = np.frombuffer(b"".join(known), "<u4")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        per_word = sizes[codes]
        firsts = (np.cumsum(sizes) - sizes)[codes]
        ends = np.cumsum(per_word)
        total = int(ends[-1]) if len(ends) else 0
        ids = vocabulary[np.repeat(firsts - (ends - per_word), per_word) + np.arange(total)]
        lists = words.offsets.to_numpy() - words.offsets[0].as_py()
        bounds = np.concatenate([[0], ends])[lists]
        if not len(odd):
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for k in odd:
            parts[k] = self.whole(texts[int(k)].as_py())
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return np.concatenate(parts), bounds


class Packer:
    """The windows of one task; pieces leave as (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, first: int, kind: str = "<u4"):
        self.window, self.next, self.kind = window, first, kind
        self.levels = np.zeros(window + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        n, c = len(ids), self.window
        full = n - n % c
        for at in range(0, full, c):
            self.done.append((doc_id, at, ids[at : at + c], n, self.fresh(), 0))
        if n > full:
            self.place((doc_id, full, ids[full:].astype(self.kind), n))  # a copy: the full windows' ids go

    def place(self, piece: tuple) -> None:
        levels, c, size = self.levels, self.window, len(piece[2])
        # growth of the sum of squares, halved, of moving one window from h to h + size
        growth = levels[size:] - levels[: c + 1 - size] + 1.0
        growth[-1] -= levels[c] + 0.5
        growth[0] = levels[size] + 0.5 if size < c else 0.0
        growth[1:][levels[1 : c + 1 - size] == 0] = np.inf
        level = c - size - int(np.argmin(growth[::-1]))
        if level:
            levels[level] -= 1
            sequence = self.stacks[level].pop()
        else:
            self.open[sequence := self.fresh()] = []
        self.open[sequence].append((*piece, sequence, level))
        if level + size == c:
            self.done += self.open.pop(sequence)
        else:
            levels[level + size] += 1
            self.stacks[level + size].append(sequence)

    def close_out(self) -> None:
        """At the end, fill the fullest open windows with the cut-up contents of the emptiest; one is left at most."""
        fill = sorted((sum(len(p[2]) for p in pieces), s) for s, pieces in self.open.items())
        low, high = 0, len(fill) - 1
        spare: list[tuple] = []
        while low < high or (low == high and spare):
            have, sequence = fill[high]
            while have < self.window and (spare or low < high):
                if not spare:
                    spare = [p[:4] for p in self.open.pop(fill[low][1])]
                    low += 1
                doc_id, start, ids, n = spare.pop()
                room = self.window - have
                self.open[sequence].append((doc_id, start, ids[:room], n, sequence, have))
                if len(ids) > room:
                    spare.append((doc_id, start + room, ids[room:], n))
                have += min(room, len(ids))
            fill[high] = (have, sequence)
            if have < self.window:
                break
            self.done += self.open.pop(sequence)
            high -= 1
        rest = [p[:4] for pieces in self.open.values() for p in pieces] + spare
        self.open.clear()
        self.levels[:] = 0
        for stack in self.stacks:
            stack.clear()
        have = sum(len(p[2]) for p in rest)
        if not have:
            return
        sequence, level = self.fresh(), 0
        for doc_id, start, ids, n in rest:
            self.open.setdefault(sequence, []).append((doc_id, start, ids, n, sequence, level))
            level += len(ids)
        self.levels[have] += 1
        self.stacks[have].append(sequence)

    def finish(self) -> None:
        self.close_out()
        rest = [p[:4] for pieces in self.open.values() for p in pieces]
        have = sum(len(p[2]) for p in rest)
        rest.reverse()
        for bit in range(have.bit_length() - 1, -1, -1):
            if have >> bit & 1:
                sequence, level = self.fresh(), 0
                while level < 1 << bit:
                    doc_id, start, ids, n = rest.pop()
                    take = min(len(ids), (1 << bit) - level)
                    self.done.append((doc_id, start, ids[:take], n, sequence, level))
                    if take < len(ids):
                        rest.append((doc_id, start + take, ids[take:], n))
                    level += take
        self.open.clear()

    def drain(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        cols = [
            [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows],
            [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows],
        ]
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id and text; other columns are ignored. Null and empty texts are one end id. Repeated rows
    are packed as often as they come. An empty table gives no rows. A null doc_id stays null.
    Sequence ids are unique, not dense: a task's number times 2^36 and up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 36, "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        for part in slices(batches):
            doc_ids, (ids, bounds) = part.column(0).to_pylist(), encode(part.column(1))
            for k, doc_id in enumerate(doc_ids):
                packer.add(doc_id, np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END_ID)).astype("<u4"))
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
