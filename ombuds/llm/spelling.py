"""Spelling variants: words one code point apart, found by a bit-sliced position index.

``vocabulary`` counts the words of a corpus; ``variants`` gives each word the near word with the
largest count, its near-word count, and the root that its forms lead to.

Index: for a set of words, each (position, letter) pair has a bitset over the set, one bit a
word. A query word runs through its letters once; four word-parallel recurrences follow the
words that agree so far without an error, and with one error as a replaced, a surplus or a missing
letter, the last two by bitsets of the position before or after. A last AND with the bitset of
the right length gives all near words at once. Words are numbered by (count descending, word),
so the first set bit is the best near word, and the number of set bits the near-word count.

Sets: of two near words of c and c or c + 1 letters, the first c // 2 letters agree, or the last
c // 2 do (one error cannot touch both ends). So each word goes to the sets of its own length and
of one less, by its first and by its last letters (reversed words, the same index); the
second side leaves out pairs whose first letters agree, so none is counted twice. Sets share an
index of about ``BLOCK`` words. A set of more words is cut into blocks, and its words ask each
block; every link is found, whatever the size.

Defined results: a null text has no words, a null id counts as an empty id in the deletion rule;
repeated rows count as often as they occur; an empty table gives no rows; equal counts go to the
smaller word in code-point order. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .words import Words, slices

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
FACTOR = 5
#: One run in so many, by crc32, loses a code point.
DELETED = 199
#: Words of an index.
BLOCK = 4096
#: Counts that a task holds before it hands them on.
HELD = 500_000

# Letters are A-Z, a-z and U+00C0 to U+00FF: the bytes C3 80 to C3 BF.
_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = _LETTER[0xC3] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


class Runs(Words):
    """Maximal runs of letters of a slice of texts."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        ink = _LETTER[raw]
        ink[1:] |= raw[:-1] == 0xC3  # what follows C3 in UTF-8 is its second byte
        super().__init__(ink.view(np.uint8), off, np.array([True, False] + [False] * 254))
        self.ink, self.raw = ink, raw

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(code of each run, the distinct runs in lower case)."""
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [
            None, pa.py_buffer(ends), pa.py_buffer(_FOLD[self.raw[self.ink]])])
        coded = flat.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _zero_bytes(crc: np.ndarray) -> np.ndarray:
    """The checksums (without their final inversion) after one more zero byte."""
    return (crc >> np.uint32(8)) ^ _CRC[crc & np.uint32(255)]


_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def joined_crc(prefix: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of prefix + word for each pair, from both checksums and the word's bytes.

    The checksum is linear: that of the prefix moves on by as many zero bytes as the word has.
    """
    order = np.argsort(-size, kind="stable")
    moved = prefix[order]
    left = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for n in left.tolist():  # n: how many words have a byte more
        moved[:n] = _zero_bytes(moved[:n])
    out = np.empty_like(moved)
    out[order] = moved
    return out ^ word


def count_words(batches):
    """Batches of (id as text, text) to (word, n)."""
    held: list[pa.Table] = []
    rows = 0

    def total(tables):
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for b in batches:
        prefix = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in b.column(0).to_pylist()], np.uint32)
        for i, _, raw, off in slices(b.column(1)):
            runs = Runs(raw, off)
            if not len(runs.start):
                continue
            code, word = runs.coded()
            texts = word.to_pylist()
            size = np.array([len(w) for w in texts])
            letters = np.array([len(w) - w.count(b"\xc3") for w in texts])
            check = np.array([zlib.crc32(w) for w in texts], np.uint32)
            h = joined_crc(prefix[i + runs.doc], check[code], size[code])
            hit = h % DELETED == 0
            n = np.bincount(code[~hit], minlength=len(texts))
            some = np.flatnonzero((n > 0) & (letters >= LEAST_LENGTH))
            cut = []
            for c, at in zip(code[hit].tolist(), h[hit].tolist()):
                if letters[c] > LEAST_LENGTH:
                    w = texts[c].decode()
                    at %= len(w)
                    cut.append(w[:at] + w[at + 1:])
            held.append(pa.table({
                "word": pa.concat_arrays([word.take(pa.array(some)).cast(pa.string()), pa.array(cut, pa.string())]),
                "n": np.concatenate([n[some], np.ones(len(cut), np.int64)])}))
            rows += len(some) + len(cut)
            if rows > HELD:
                yield from total(held).to_batches(max_chunksize=20_000)
                held, rows = [], 0
    if held:
        yield from total(held).to_batches(max_chunksize=20_000)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT)


class PositionIndex:
    """Bitsets over words by (position, letter) and by length; letters are Latin-1 bytes."""

    def __init__(self, words: list[bytes]):
        self.size = len(words)
        self.length = np.array([len(w) for w in words])
        self.longest = int(self.length.max(initial=0))
        letters = np.zeros((len(words), self.longest + 1), np.uint8)  # 0: beyond the end
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(len(words)), self.length)
        letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)] = flat
        self.letters = letters
        self.used = np.unique(flat)
        self.code = np.full(256, len(self.used))  # letters that no word has share an empty bitset
        self.code[self.used] = np.arange(len(self.used))
        #: at[i][c]: words with letter c at position i
        self.at = [self.bits([letters[:, i] == c for c in self.used]) for i in range(self.longest + 1)]
        self.of_length = self.bits([self.length == n for n in range(self.longest + 2)], False)

    def bits(self, masks: list[np.ndarray], empty: bool = True) -> np.ndarray:
        """Each mask over the words as a row of 64-bit numbers; then, if asked, an empty row."""
        wide = np.zeros((len(masks) + empty, -(-max(1, self.size) // 64) * 64), bool)
        for i, m in enumerate(masks):
            wide[i, :self.size] = m
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def rows(self, i: int, letters: np.ndarray) -> np.ndarray:
        """For each query letter the words that have it at position i."""
        if not 0 <= i <= self.longest:
            return np.zeros((len(letters), self.of_length.shape[1]), np.uint64)
        return self.at[i][self.code[letters]]

    def near(self, words: np.ndarray, same: int, lengths: tuple[int, ...]) -> np.ndarray:
        """Bitsets of the words of the given lengths one error away from each query word.

        words: [queries, m] letters, all of m letters; the first ``same`` letters must agree.
        """
        count, m = words.shape
        none = np.zeros((count, self.of_length.shape[1]), np.uint64)
        exact = np.repeat(self.bits([np.ones(self.size, bool)], False), count, 0)
        replaced, surplus, missing = none.copy(), none.copy(), none.copy()
        for i in range(m):
            here = self.rows(i, words[:, i])
            if i < same:
                exact &= here
                continue
            # one error so far: this letter replaced, this letter surplus, a letter missing before it
            if m in lengths:
                replaced = replaced & here | exact & ~here
            if m - 1 in lengths:
                surplus = surplus & self.rows(i - 1, words[:, i]) | exact
            if m + 1 in lengths:
                missing = (missing | exact) & self.rows(i + 1, words[:, i])
            exact = exact & here
        out = none
        for n, found in ((m, replaced), (m - 1, surplus), (m + 1, missing | exact)):
            if n in lengths and n < len(self.of_length):
                out = out | found & self.of_length[n]
        return out


def search(key, rows):
    """One index: for each asking word its number of near words in the index and the best one."""
    c, side = key[0].as_py(), key[1].as_py() == 1
    rows = rows.combine_chunks()
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    turned = [w[::-1] for w in words] if side else words
    n = rows.column("n").to_numpy()
    ask, index = (np.flatnonzero(rows.column(c).to_numpy()) for c in ("asks", "holds"))
    index = np.array(sorted(index.tolist(), key=lambda i: (-n[i], words[i])), np.int64)
    found = []
    if len(ask) and len(index) and min(map(len, words)) == c:  # else all are of the longer length
        found = block(PositionIndex([turned[i] for i in index]), [turned[i] for i in ask], ask, index, c, side)
    cols = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64)] * 3
    word = rows.column("word").combine_chunks()
    return pa.table({"word": word.take(pa.array(cols[0])), "n_near": cols[1],
                     "form": word.take(pa.array(cols[2])), "form_n": n[cols[2]]})


def block(index: PositionIndex, asked: list[bytes], ask: np.ndarray, rows: np.ndarray, c: int, side: bool):
    """(asking rows, near-word counts, rows of the best) for asking words that have near words."""
    half = c // 2
    size = np.array([len(w) for w in asked])
    out = []
    for m in np.unique(size).tolist():
        pick = np.flatnonzero(size == m)
        lengths = (c, c + 1) if m == c else (c,)
        for at in range(0, len(pick), 512):
            some = pick[at:at + 512]
            letters = np.frombuffer(b"".join(asked[i] for i in some), np.uint8).reshape(len(some), m)
            near = index.near(letters, half, lengths)
            if side:  # pairs whose other ends agree too belong to the first side
                near &= ~first_letters(index, letters, half)
            bits = np.bitwise_count(near).sum(1).astype(np.int64)
            hit = np.flatnonzero(bits)
            lead = (near[hit] != 0).argmax(1)
            value = near[hit, lead]
            low = np.bitwise_count((value & (~value + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            out.append((ask[some[hit]], bits[hit], rows[lead * 64 + low]))
    return out


def first_letters(index: PositionIndex, letters: np.ndarray, half: int) -> np.ndarray:
    """Of reversed words: those whose last ``half`` letters (the first before) agree as well."""
    m = letters.shape[1]
    out = np.zeros((len(letters), index.of_length.shape[1]), np.uint64)
    for n in (m - 1, m, m + 1):
        if 0 <= n < len(index.of_length):
            agree = np.repeat(index.of_length[n][None], len(letters), 0)
            for k in range(1, half + 1):
                agree &= index.rows(n - k, letters[:, m - k])
            out |= agree
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words, from rows (word, n)."""
    size = F.length("word")
    shorter, side = F.explode(F.array(size, size - 1)), F.explode(F.array(F.lit(0), F.lit(1)))
    sets = words.select("word", "n", shorter.alias("shorter")).select("*", side.alias("side"))
    half = F.floor(F.col("shorter") / 2).cast("int")
    ends = F.when(F.col("side") == 0, F.left("word", half)).otherwise(F.right("word", half))
    sets = sets.select("*", ends.alias("ends"))
    kind, keys = ["shorter", "side"], ["shorter", "side", "ends"]
    sizes = sets.groupBy(*keys).agg(F.count("*").alias("size"))
    indexes = sizes.groupBy(*kind).agg(F.ceil(F.sum("size") * 2 / BLOCK).alias("indexes"))
    large = sizes.where(F.col("size") > BLOCK).select(*keys, F.ceil(F.col("size") / BLOCK).alias("cuts"))
    dealt = sets.join(indexes, kind).join(large, keys, "left")

    row = ["word", "n", *kind]
    yes, no = F.lit(True), F.lit(False)
    usual = dealt.where("cuts is null").select(
        *row, yes.alias("asks"), yes.alias("holds"), F.pmod(F.xxhash64("ends"), "indexes").alias("i"),
        F.lit(-1).cast("long").alias("j"))
    # in a large set, words of block i ask the index of block j
    cut = dealt.where("cuts is not null").select(
        *row, "ends", F.pmod(F.xxhash64("word"), "cuts").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("other"))
    asks = cut.select(*row, "ends", yes.alias("asks"), (F.col("part") == F.col("other")).alias("holds"),
                      F.col("part").alias("i"), F.col("other").alias("j"))
    holds = cut.where("part <> other").select(*row, "ends", no.alias("asks"), yes.alias("holds"),
                                              F.col("other").alias("i"), F.col("part").alias("j"))
    cut = asks.unionAll(holds).select(*row, "asks", "holds", F.xxhash64("ends", "i").alias("i"), "j")
    found = usual.unionAll(cut).groupBy(*kind, "i", "j").applyInArrow(
        search, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("fewer"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", "best.form", (-F.col("best.fewer")).alias("form_n"))


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    spark = words.sparkSession
    words = written(spark, words, "vocabulary")
    near = near_words(words)
    rows = words.join(near, "word", "left")
    far = F.col("form_n") >= factor * F.col("n")
    rows = written(spark, rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                      F.when(far, F.col("form")).alias("form"),
                                      F.when(far, F.col("form_n")).alias("form_n")), "forms")
    # each step multiplies the count by the factor at least, so chains are short; pointers double
    step = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = step.join(onward, "root", "left")
        new = written(spark, moved.select("word", F.coalesce("next", "root").alias("root"),
                                          F.col("next").isNotNull().alias("moved")), "roots")
        more = new.where("moved").limit(1).count()
        step = new.select("word", "root")
        if not more:
            break
    return rows.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                  "n", "n_near", "form_n")
