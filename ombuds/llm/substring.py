"""Removal of repeated word passages with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words. Words covered by a window that also starts earlier
(smaller document id, or earlier in the same document) are removed.

Sharding by content. The seed of a window is its least ``GRAM``-word hash (the leftmost of
equals), so equal windows have equal seeds. Windows in a row that share a seed at the same
place form a run. Only runs whose seed occurs elsewhere can hold a repeated window. Equal runs
are settled by counting: all but the first are repeats. The first ones, of seeds that have
several different runs, go to the shard of their seed; runs of very frequent seeds are cut
into single windows there, each to the shard of its own hash, so no seed fills a shard.

In a shard the runs are joined in document order. An FM-index is built over their words: the
suffix order to the depth of a window, the Burrows-Wheeler sequence in a wavelet matrix of bit
vectors with popcount ranks. Each run is then streamed from its last word to its first by
backward search, which keeps the matching statistic at each position: the suffix interval of
the next words, lengthened by a word and cut back to a window less one. An interval of
a full window is in text order, so its first suffix tells if the window starts earlier.

Defined results: null texts have no words; null ids come before all others; of rows with equal
ids the order is that of the scan; texts shorter than a window stay whole. Only the id and text
columns are read (``remove`` carries the others along).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, few, written
from .marks import among, collected, flagged, marks
from .words import Words, grams, inside, mix, slices, span_hashes

WINDOW, GRAM = 20, 5
#: Occurrences from which the runs of a seed are dealt to shards by window.
FREQUENT = 4096
#: Bits of the sets of seeds and of texts to be looked at (16 MB).
SEED_BITS = 1 << 27
#: Words of a shard, about.
SHARD_WORDS = 1_000_000


def runs(w: Words, h: np.ndarray):
    """(text, seed, first word in the text, number of windows) of every run of a slice, in order."""
    total = len(h)
    if total < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    g = grams(h, GRAM)
    width = WINDOW - GRAM + 1
    m = total - WINDOW + 1
    # least gram of each window by doubling: (value, leftmost place)
    best, at, span = g.copy(), np.arange(len(g)), 1
    while span < width:
        shift = min(span, width - span)
        other, there = best[shift:], at[shift:]
        n = len(other)
        swap = other < best[:n]
        best, at = np.where(swap, other, best[:n]), np.where(swap, there, at[:n])
        span += shift
    ok = inside(w.first, WINDOW)
    begin = np.flatnonzero(ok)
    place = at[:m][begin]
    new = np.ones(len(begin), bool)
    new[1:] = (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)
    s = np.flatnonzero(new)
    doc = w.doc[begin[s]]
    return doc, g[place[s]], begin[s] - w.first[doc], np.diff(np.append(s, len(begin)))


class BitVector:
    """Bits with ranks: 64-bit words and counts before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        pad = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
        pad[:self.n] = bits
        self.words = np.packbits(pad, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        self.zeros = self.n - int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Index of a sequence of symbols (0: end of a run) whose suffixes are ordered to ``depth``."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.depth = depth
        rank, have = text.astype(np.int64), 1
        for target in (2, 4, 8, 16, depth - 1, depth):
            if have < target <= depth:
                shift = target - have
                nxt = np.zeros(n, np.int64)
                nxt[:n - shift] = rank[shift:] + 1
                _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + nxt, return_inverse=True)
                have = target
                if target == depth - 1:
                    shorter = rank
        self.suffix = np.argsort(rank, kind="stable")  # equal ones stay in text order
        ordered = shorter[self.suffix]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        # the interval of the first depth - 1 symbols, for every place in the order
        self.low, self.high = starts[group], np.append(starts[1:], n)[group]
        bwt = text[self.suffix - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels: list[BitVector] = []
        bits = max(1, int(text.max(initial=0)).bit_length())
        self.bits = bits
        for b in range(bits - 1, -1, -1):
            bit = ((bwt >> b) & 1).astype(np.uint8)
            v = BitVector(bit)
            self.levels.append(v)
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """One step of backward search: the intervals with ``symbol`` put in front."""
        start = np.zeros(len(symbol), np.int64)
        i, j, s = low.astype(np.int64), high.astype(np.int64), start
        for b, v in zip(range(self.bits - 1, -1, -1), self.levels):
            one = ((symbol >> b) & 1).astype(bool)
            ri, rj, rs = v.rank(i), v.rank(j), v.rank(s)
            i = np.where(one, v.zeros + ri, i - ri)
            j = np.where(one, v.zeros + rj, j - rj)
            s = np.where(one, v.zeros + rs, s - rs)
        base = self.first[symbol]
        return base + i - s, base + j - s


def repeated(length: np.ndarray, symbols: np.ndarray) -> list[np.ndarray]:
    """For runs (in order; their word symbols joined): which of their windows start earlier too."""
    n_runs = len(length)
    if not n_runs:
        return []
    begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    text = np.zeros(int(length.sum()) + n_runs, np.int64)
    _, dense = np.unique(symbols, return_inverse=True)
    of = np.repeat(np.arange(n_runs), length)
    inner = np.arange(len(symbols)) - np.repeat(np.cumsum(length) - length, length)
    text[begin[of] + inner] = dense + 1
    fm = FMIndex(text, WINDOW)
    low = np.zeros(n_runs, np.int64)
    high = np.full(n_runs, len(text))
    known = np.zeros(n_runs, np.int64)  # words matched
    out = [np.zeros(int(k) - WINDOW + 1, bool) for k in length]
    flags = np.zeros(len(text), bool)
    for step in range(int(length.max())):
        live = np.flatnonzero(length > step)
        at = begin[live] + length[live] - 1 - step
        l, h = low[live], high[live]
        full = known[live] == WINDOW
        # cut back to a window less one: the interval around any of its suffixes
        l, h = np.where(full, fm.low[np.minimum(l, len(text) - 1)], l), np.where(full, fm.high[np.minimum(l, len(text) - 1)], h)
        l, h = fm.extend(text[at], l, h)
        low[live], high[live] = l, h
        known[live] = np.minimum(known[live] + 1, WINDOW)
        whole = known[live] == WINDOW
        flags[at[whole]] = (h[whole] - l[whole] > 1) & (fm.suffix[l[whole]] < at[whole])
    for r in range(n_runs):
        out[r] = flags[begin[r]:begin[r] + len(out[r])]
    return out


def scan(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Rows (doc_id, text, rest, seeds)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] if whole else []
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.struct(F.lit(0).alias("-"), *others).alias("rest"))

    def run(batches):
        for b in batches:
            for i, j, raw, off in slices(b.column(1)):
                w = Words(raw, off)
                doc, seed, _, _ = runs(w, w.hashes())
                cut = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                seeds = pa.ListArray.from_arrays(pa.array(cut), pa.array(seed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), seeds],
                                                 names=[*b.schema.names, "seeds"])

    return few.mapInArrow(run, T.StructType([*few.schema, T.StructField("seeds", T.ArrayType(T.LongType()))]))


def hit_runs(rows: DataFrame, repeated_seeds, frequent_seeds) -> DataFrame:
    """(uid, doc_id, key, content, start, count) of runs whose seed is in the first set.

    ``content`` and ``key`` are hashes: of the run's words, and the shard's key (the seed, or
    for a seed in the second set an independent hash of the single window that the run is cut
    into), so equal runs agree in 128 bits of two hashes. The sets are broadcast ``marks``: a run that only seems repeated is one more run, nothing else.
    """

    def run(batches):
        often, most = repeated_seeds.value, frequent_seeds.value
        for b in batches:
            for i, j, raw, off in slices(b.column(2)):
                w = Words(raw, off)
                h = w.hashes()
                part = b.slice(i, j - i)
                doc, seed, start, count = runs(w, h)
                pick = np.flatnonzero(among(often, seed))
                row, seed, start, count = doc[pick], seed[pick], start[pick], count[pick]
                cut = among(most, seed)
                rep = np.where(cut, count, 1)
                row, seed = np.repeat(row, rep), np.repeat(seed, rep)
                start = np.repeat(start, rep) + np.arange(len(row)) - np.repeat(np.cumsum(rep) - rep, rep)
                one = np.repeat(cut, rep)
                count = np.where(one, 1, np.repeat(count, rep))
                begin = w.first[row] + start
                content = span_hashes(h, begin, begin + count + WINDOW - 1)
                at = np.flatnonzero(one)
                key = seed.copy()
                key[at] = span_hashes(mix(h), begin[at], begin[at] + WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(key.view(np.int64)),
                     pa.array(content.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["uid", "doc_id", "key", "content", "start", "count"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("uid", "doc_id", "text").mapInArrow(
        run, f"uid long, doc_id {kind}, key long, content long, start int, count int")


def with_words(picked: DataFrame) -> DataFrame:
    """(key, uid, doc_id, start, words array<long>) from rows (uid, doc_id, text, at: key, start, count)."""

    def run(batches):
        for b in batches:
            for i, j, raw, off in slices(b.column(2)):
                w = Words(raw, off)
                h = w.hashes().view(np.int64)
                part = b.slice(i, j - i)
                at = part.column(3)
                row = np.repeat(np.arange(j - i), at.value_lengths().to_numpy())
                f = at.flatten()
                key, start, count = (f.field(k).to_numpy() for k in ("key", "start", "count"))
                size = count + WINDOW - 1
                begin = w.first[row] + start
                idx = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                                 pa.array(h[idx]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array(start), words], names=["key", "uid", "doc_id", "start", "words"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"key long, uid long, doc_id {kind}, start int, words array<long>")


def search_shards(segments: DataFrame) -> DataFrame:
    """(uid, start, count) of windows that an earlier run of the shard holds; one index a partition."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        t = t.take(order(t))
        words = t.column("words").combine_chunks()
        flags = repeated(words.value_lengths().to_numpy().astype(np.int64), words.flatten().to_numpy())
        uid, start = t.column("uid").to_numpy(), t.column("start").to_numpy()
        out = [(i, np.flatnonzero(f)) for i, f in enumerate(flags) if f.any()]
        if out:
            who = np.concatenate([np.full(len(k), i) for i, k in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[who]), pa.array((start[who] + np.concatenate([k for _, k in out])).astype(np.int32)),
                 pa.array(np.ones(len(who), np.int32))], names=["uid", "start", "count"])

    return segments.mapInArrow(run, "uid long, start int, count int")


def order(t: pa.Table) -> pa.Array:
    """Row order by id (null first), row number and start."""
    return pc.sort_indices(t, [("doc_id", "ascending"), ("uid", "ascending"), ("start", "ascending")],
                           null_placement="at_start")


def find(docs: DataFrame, id_col: str, text_col: str, whole: bool):
    """(written rows by uid, (uid, spans array<struct<start, count>>) of rows with repeated windows)."""
    spark = docs.sparkSession
    rows = scan(docs, id_col, text_col, whole).withColumn("uid", F.monotonically_increasing_id())
    rows = written(spark, few(rows), "scanned")
    seed = rows.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("c")).where("c > 1")
    seed = written(spark, few(seed), "seeds")
    sets = [spark.sparkContext.broadcast(collected(marks(x, F.col("seed"), SEED_BITS), SEED_BITS))
            for x in (seed, seed.where(F.col("c") >= FREQUENT))]
    run = written(spark, few(hit_runs(rows, *sets)), "runs")
    discard(seed)
    place = F.struct("doc_id", "uid", "start")
    first = run.groupBy("key", "content").agg(F.min(place).alias("f"), F.max("count").alias("count"), F.count("*").alias("c"))
    first = written(spark, few(first), "firsts")
    later = run.join(first.where("c > 1").select("key", "content", "f"), ["key", "content"]).where(
        (F.col("uid") != F.col("f.uid")) | (F.col("start") != F.col("f.start"))).select("uid", "start", "count")
    several = first.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    open_ = first.join(several, "key").select("key", F.col("f.uid").alias("uid"), F.col("f.start").alias("start"), "count")
    open_ = open_.groupBy("uid").agg(F.collect_list(F.struct("key", "start", "count")).alias("at"))
    open_ = written(spark, few(open_), "open")
    uid = F.xxhash64("uid")
    asked = written(spark, marks(open_, uid, SEED_BITS).coalesce(4), "asked")
    texts = flagged(rows.select("uid", "doc_id", "text"), uid, asked, SEED_BITS, "asked").where("asked").drop("asked")
    segments = written(spark, few(with_words(texts.join(open_, "uid"))), "segments")
    size = segments.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_WORDS), spark.sparkContext.defaultParallelism if size > 100_000 else 1)
    found = search_shards(segments.repartition(int(shards), "key"))
    spans = later.unionAll(found).groupBy("uid").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    spans = written(spark, few(spans), "spans")
    discard(run, first, open_, segments)
    for x in sets:
        x.unpersist()
    return rows, spans


def kept_text(text: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space) of one text."""
    words = text.split()
    if not len(starts):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + WINDOW - 1, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """Rows (doc_id, text, rest, n_words, n_removed, kept): ``kept`` is what is left, words joined by a space."""
    rows, spans = find(docs, id_col, text_col, whole)
    both = rows.select("doc_id", "text", "rest", "uid").join(spans, "uid", "left").drop("uid")

    def run(batches):
        for b in batches:
            raw_texts = b.column(1).to_pylist()
            out = []
            for text, sp in zip(raw_texts, b.column(3)):
                s = sp.values if sp.is_valid else None
                starts = s.field("start").to_numpy() if s is not None else np.zeros(0, np.int64)
                counts = s.field("count").to_numpy() if s is not None else starts
                out.append(kept_text((text or "").encode(), starts, counts))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array([k.decode() for k in kept], pa.string())],
                names=["doc_id", "text", "rest", "n_words", "n_removed", "kept"])

    schema = T.StructType([both.schema[c] for c in ("doc_id", "text", "rest")]
                          + T.StructType.fromDDL("n_words long, n_removed long, kept string").fields)
    return both.mapInArrow(run, schema)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages removed; texts without any are unchanged."""
    out = remove(docs, id_col, text_col)
    place = {id_col: F.col("doc_id"),
             text_col: F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))}
    return out.select(*(place.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
