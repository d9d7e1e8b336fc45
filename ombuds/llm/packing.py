"""Sum-of-squares online packing of documents into fixed windows.

Each document arrives once, in scan order, and is placed into the fill level that minimises
the sum of squared counts of partially filled windows, tracked in a level array: a piece of
size s moves a window from level h to h + s and changes the sum by
``(1 - 2 N[h]) + (1 + 2 N[h + s])`` (no first term for a new window, no second for a full one).
A document longer than a window is cut into full windows and one rest. Where windows are open
but none has room for a piece, its head fills one of the commonest level and the rest is placed
anew, so documents of one size above half a window do not leave a window each. Every task packs
what it reads and holds the ids of its open windows only. When a task's input ends, its open
windows are merged by cutting: fuller windows are filled up from emptier ones, and the last
rest is split into lengths that are powers of two, which need no padding. So there is none.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often
as they occur; an empty table gives no rows. Only the id and text columns are read, so names
of further columns cannot clash.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import utf8

WINDOW = 2048
END_ID = 1
#: Words whose ids a Python process remembers; the memory is emptied when it is full.
REMEMBERED = 1_000_000

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def added_tokens(path: str) -> re.Pattern:
    """Finds the tokenizer's added tokens, which it takes out of a text before anything else."""
    names = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, names)) if names else "(?!)")


#: Words that are split here: printable ASCII and the Latin-1 letters, which are composed already
#: and lower to one letter each. All other words take the tokenizer's own normalising path.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The tokenizer's split pattern over these characters, after lowering.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]"
                    "|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Marks that are a part of their own after letters.
_MARKS = frozenset(b".,;:!?")
#: The byte-level alphabet: each UTF-8 byte as a printable character.
_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _BYTES} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_BYTES))}


class WordIds(dict):
    """Ids of words, as little-endian bytes. The tokenizer never joins over white space.

    Rare words cost most: the merges of a plain word's parts are run on the model itself,
    without the normaliser's bookkeeping. Parts are remembered beside words; a part that
    stands alone as a word has the same ids.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self.merges = tokenizer(path).model.tokenize

    def part(self, low: bytes) -> bytes:
        """Ids of one part of a plain word, in lower case."""
        got = self.get(low)
        if got is None:
            letters = low.decode() if low.isascii() else low.decode("latin-1").translate(_ALPHABET)
            found = [t.id for t in self.merges(letters)]
            got = self[low] = struct.pack(f"<{len(found)}I", *found)
        return got

    def meet(self, words: set) -> None:
        """Remember every one of the words; what was known is forgotten when there are too many."""
        new = list(itertools.filterfalse(self.__contains__, words))
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = words
        self.learn(new)

    def learn(self, new) -> None:
        """Remember distinct words that are not remembered yet."""
        other = []
        part, added = self.part, added_tokens(self.path)
        for w in new:
            if w.isalpha():  # ASCII letters alone, as most words: one part
                self[w] = part(w.lower())
                continue
            if w[-1] in _MARKS and w[:-1].isalpha():  # and a mark after them
                self[w] = part(w[:-1].lower()) + part(w[-1:])
                continue
            text = w.decode()
            if not _PLAIN.fullmatch(text) or added.search(text):
                other.append(w)
                continue
            self[w] = b"".join([part(p.encode()) for p in _PARTS.findall(text.lower())])
        for i in range(0, len(other), 20_000):
            some = other[i:i + 20_000]
            got = tokenizer(self.path).encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            for w, e in zip(some, got):
                self[w] = np.array(e.ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_docs(texts: list[bytes], path: str, group: int = 256):
    """Yields each text's ids as little-endian bytes, without an end id."""
    memory = word_ids(path)
    for i in range(0, len(texts), group):
        split = [t.split() for t in texts[i:i + group]]
        memory.meet(set().union(*split))
        for ws in split:
            yield b"".join(map(memory.__getitem__, ws))


class SumOfSquares:
    """Open windows by level. ``place`` picks the level; a window is a list of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.open: dict[int, list] = {}
        self.clear()

    def clear(self) -> None:
        self.open.clear()
        self.count = np.zeros(self.window + 1, np.int64)
        # what the sum changes by when a window leaves a level (0: a new one), and when it enters
        self.leave = np.full(self.window + 1, np.iinfo(np.int64).max // 2)
        self.leave[0] = 0
        self.enter = np.ones(self.window + 1, np.int64)
        self.enter[self.window] = 0

    def add(self, level: int, change: int) -> None:
        """Count a window more or less at a level between empty and full."""
        n = int(self.count[level]) + change
        self.count[level] = n
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 2
        self.enter[level] = 1 + 2 * n

    def level_for(self, size: int) -> int:
        """Level (0: a new window) whose window takes the piece at the least sum of squares."""
        room = self.window - size
        cost = self.leave[:room + 1] + self.enter[size:]
        return room - int(cost[::-1].argmin())  # of equals the fullest

    def place(self, piece: tuple, size: int) -> list | None:
        """Place one piece; returns the window's pieces once it is full."""
        return self.move(piece, size, self.level_for(size))

    def move(self, piece: tuple, size: int, level: int) -> list | None:
        if level:
            pieces = self.open[level].pop()
            self.add(level, -1)
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open.setdefault(level + size, []).append(pieces)
        self.add(level + size, 1)
        return None

    def put(self, piece: tuple):
        """Place a piece; where windows are open but none has room for it all, its head fills one.

        Yields the windows that get full. The window to fill is one of the commonest level, which
        lessens the sum of squares most (of equals the fullest)."""
        while piece is not None:
            size, rest = size_of(piece), None
            level, room = self.level_for(size), self.window - size
            if not level and room and not self.count[1:room + 1].any():
                over = self.count[room + 1:]
                if over.any():
                    level = self.window - int(over[::-1].argmax())
                    size = self.window - level
                    piece, rest = cut(piece, size)
            full = self.move(piece, size, level)
            if full:
                yield full
            piece = rest

    def drain(self):
        """Merge the open windows by cutting; yields windows that are full or a power of two."""
        left = [(level, w) for level, ws in self.open.items() for w in ws]
        left.sort(key=lambda x: x[0], reverse=True)
        give: list[tuple] = []  # pieces of the emptiest windows, to be cut
        lo, hi = 0, len(left) - 1
        while lo <= hi:
            level, pieces = left[lo]
            lo += 1
            while level < self.window and (give or lo <= hi):
                if not give:
                    give = list(left[hi][1])
                    hi -= 1
                part = give.pop()
                fit = self.window - level
                head, tail = cut(part, fit)
                pieces.append(head)
                level += size_of(head)
                if tail is not None:
                    give.append(tail)
            if level == self.window:
                yield pieces
            else:
                give = pieces[::-1]
        while give:
            total = sum(map(size_of, give))
            want = min(self.window, 1 << (total.bit_length() - 1))
            out, got = [], 0
            while got < want:
                head, tail = cut(give.pop(), want - got)
                out.append(head)
                got += size_of(head)
                if tail is not None:
                    give.append(tail)
            yield out
        self.clear()


def size_of(piece: tuple) -> int:
    return len(piece[2]) // 4


def cut(piece: tuple, size: int):
    """(first ``size`` ids, the rest or None) of a (doc_id, start, ids, doc_tokens) piece."""
    doc, start, ids, total = piece
    if size_of(piece) <= size:
        return piece, None
    return (doc, start, ids[:4 * size], total), (doc, start + size, ids[4 * size:], total)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and its ids.

    ``ids`` are little-endian unsigned 32-bit integers. ``sequence_id`` is the task's number
    times 2**36 plus a running number; ``offset`` is gapless from 0 in each sequence.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId() << 36
        packer, n = SumOfSquares(window), 0
        rows: list[tuple] = []

        def close(pieces):
            nonlocal n
            at = 0
            for doc, start, ids, total in pieces:
                k = len(ids) // 4
                rows.append((doc, start, k, total, task + n, at, ids))
                at += k
            n += 1

        for b in batches:
            raw, off = utf8(b.column(1))
            whole, off = raw.tobytes(), off.tolist()
            texts = [whole[i:j] for i, j in zip(off, off[1:])]
            for doc, ids in zip(b.column(0).to_pylist(), encode_docs(texts, tokenizer_path)):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, window):
                    part = ids[4 * at:4 * (at + window)]
                    for full in packer.put((doc, at, part, total)):
                        close(full)
                if len(rows) >= 4096:
                    yield table(rows)
                    rows.clear()
        for pieces in packer.drain():
            close(pieces)
        if rows:
            yield table(rows)

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, SCHEMA)


def table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
