"""Near-duplicates by ProbMinHash, banding and exact verification.

A text is its five-word shingles, weighted by how often each occurs. Similarity is the
probability Jaccard similarity (for texts without repeats the plain one): the chance that two
texts agree in a register of their ProbMinHash signatures. Every shingle is a Poisson
process whose rate is its weight; each arrival goes to a random register, the earliest
arrival keeps it, and a shingle stops as soon as it is later than every register.

32 bands of 5 registers make buckets (a pair at 0.8 misses all of them once in 300,000).
Texts of the same words are one node, so groups of copies never meet as pairs. Buckets that
share nodes make a cluster, which is cut into blocks of about ``BLOCK`` nodes. In a block, and
then between blocks, pairs are taken by the agreement of their signatures, the likeliest first;
pairs whose classes are joined already are skipped, since they cannot change them, and the
others are verified on the whole texts. Only links that join classes leave a block. A cluster
of one class over many blocks is joined by the blocks' medoids first, so that only nodes
outside it still meet all blocks. A signature agreement below 0.66 (over four standard
deviations under 0.8; once in 100,000 pairs at 0.8) is no pair.

Defined results: null texts and texts without words are each a class of their own; texts of one
to four words have one shingle, all their words; repeated rows fall into one class; a null id is
kept and ordered first. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, few, written
from .graph import components
from .marks import flagged, marks
from .words import Words, grams, inside, mix, slices, span_hashes, stream, utf8

SHINGLE = 5
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
LEAST_AGREEMENT = 0.66
#: Bits of the sets that tell which rows to shuffle at all (4 MB).
MARK_BITS = 1 << 25
#: Nodes of a cluster that meet in one task as a block, about.
BLOCK = 256


def shingles(w: Words, h: np.ndarray):
    """(text, shingle hash, weight) of a slice, sorted by text."""
    g, ok = grams(h, SHINGLE), inside(w.first, SHINGLE)
    doc, g = w.doc[:len(g)][ok], g[ok]
    few = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    if len(few):
        doc = np.concatenate([doc, few])
        g = np.concatenate([g, span_hashes(h, w.first[few], w.first[few + 1])])
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (g >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    weight = np.diff(np.append(at, len(new))).astype(float)
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), weight


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """[n, REGISTERS] element that holds each register of each text."""
    time = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, np.uint64)
    seed, at = mix(element), np.zeros(len(element))
    t = 0
    while len(doc):
        u = stream(seed, 2 * t)
        at = at - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / weight
        slot = doc * REGISTERS + (stream(seed, 2 * t + 1) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(time, slot, at)
        won = at == time[slot]
        holder[slot[won]] = element[won]
        last = time.reshape(n, REGISTERS).max(1)
        go = at < last[doc]
        doc, element, weight, seed, at = doc[go], element[go], weight[go], seed[go], at[go]
        t += 1
    return holder.reshape(n, REGISTERS)


def profile(raw: np.ndarray, off: np.ndarray):
    """(number of words, two 64-bit keys of the word sequence, bands, one-byte registers)."""
    n = len(off) - 1
    w = Words(raw, off)
    h = w.hashes()
    k1 = span_hashes(h, w.first[:-1], w.first[1:])
    k2 = span_hashes(mix(h), w.first[:-1], w.first[1:])
    sig = signatures(*shingles(w, h), n)
    bands = np.empty((n, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            x = np.full(n, np.uint64(b + 1))
            for r in range(ROWS):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
            bands[:, b] = x
    return w.count, k1, k2, bands, (mix(sig) & np.uint64(0xFF)).astype(np.uint8)


def profiles(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Rows (doc_id, text, rest, n, k1, k2, bands, sig); ``rest`` holds the other columns if ``whole``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] if whole else []
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.struct(F.lit(0).alias("-"), *others).alias("rest"))

    def run(batches):
        for b in batches:
            for i, j, raw, off in slices(b.column(1)):
                n, k1, k2, bands, sig = profile(raw, off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, np.int32)),
                                                 pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in b.columns), pa.array(n.astype(np.int32)),
                     pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists,
                     pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=[*b.schema.names, "n", "k1", "k2", "bands", "sig"])

    added = T.StructType.fromDDL("n int, k1 long, k2 long, bands array<long>, sig binary")
    return few.mapInArrow(run, T.StructType([*few.schema, *added]))


def similarity(a, b) -> float:
    """Probability Jaccard similarity of two (sorted shingles, weights)."""
    (ha, wa), (hb, wb) = a, b
    every = np.union1d(ha, hb)
    x, y = np.zeros((2, len(every)))
    x[np.searchsorted(every, ha)] = wa
    y[np.searchsorted(every, hb)] = wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.searchsorted(ratio, ratio, "left")  # elements of a smaller ratio
    sx, sy = np.append(np.cumsum(x[::-1])[::-1], 0), np.concatenate([[0], np.cumsum(y)])
    both = (x > 0) & (y > 0)
    return float((1.0 / (sx[below[both]] / x[both] + sy[below[both]] / y[both])).sum())


def bag(raw: np.ndarray, off: np.ndarray) -> list:
    """(sorted shingles, weights) of each text of a slice."""
    w = Words(raw, off)
    doc, g, weight = shingles(w, w.hashes())
    cut = np.searchsorted(doc, np.arange(len(off)))
    return [(g[i:j], weight[i:j]) for i, j in zip(cut, cut[1:])]


class Sets:
    """Union-find over the roots of some nodes."""

    def __init__(self, roots):
        self.up = {r: r for r in roots}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = sorted((self.root(x), self.root(y)))
        self.up[b] = a


def connect(sets: Sets, root: np.ndarray, sig: np.ndarray, texts: pa.Array, left: np.ndarray, right: np.ndarray,
            threshold: float) -> list[tuple[int, int]]:
    """Join the roots of left and right nodes that are similar enough; the links that did so.

    Likely pairs come first; a pair whose roots are joined already is not compared."""
    at_a, at_b, agreement = [], [], []
    for i in left.tolist():
        agree = (sig[right] == sig[i]).mean(1)
        near = (agree >= LEAST_AGREEMENT) & (root[right] != root[i])
        if left is right:
            near &= right > i
        at_b.append(right[near])
        at_a.append(np.full(int(near.sum()), i))
        agreement.append(agree[near])
    if not at_a:
        return []
    a, b, agree = np.concatenate(at_a), np.concatenate(at_b), np.concatenate(agreement)
    order = np.lexsort((b, a, -agree))
    known: dict[int, tuple] = {}

    def of(i: int) -> tuple:
        if i not in known:
            raw, off = utf8(texts.slice(i, 1))
            known[i] = bag(raw, off)[0]
        return known[i]

    links = []
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = sets.root(root[i]), sets.root(root[j])
        if x != y and similarity(of(i), of(j)) >= threshold:
            sets.join(x, y)
            links.append((x, y))
    return links


def signature_rows(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, REGISTERS)


def settle(candidates: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of candidates (cluster, nb, block, node, text, sig): roots are least nodes of classes."""
    spark = candidates.sparkSession

    def within(t: pa.Table) -> pa.Table:
        """All pairs of a block; its largest class names a medoid."""
        node, sig = t.column("node").to_numpy(), signature_rows(t)
        sets, every = Sets(node.tolist()), np.arange(len(node))
        connect(sets, node, sig, t.column("text").combine_chunks(), every, every, threshold)
        root = np.array([sets.root(x) for x in node.tolist()])
        names, count = np.unique(root, return_counts=True)
        mine = np.flatnonzero(root == names[count.argmax()])
        consensus = np.array([(sig[mine] == sig[i]).mean() for i in mine])
        medoid = np.zeros(len(node), bool)
        medoid[mine[consensus.argmax()]] = True
        return pa.table({"cluster": t.column("cluster"), "nb": t.column("nb"), "block": t.column("block"),
                         "node": node, "root": root, "medoid": medoid})

    first = written(spark, few(candidates.groupBy("cluster", "block").applyInArrow(
        within, "cluster long, nb long, block long, node long, root long, medoid boolean")), "blocks")
    large = first.where("nb > 1")
    if not large.limit(1).count():  # every cluster was one block
        return first.select("node", "root")
    body = candidates.where("nb > 1").select("node", "text", "sig")

    def between(t: pa.Table) -> pa.Table:
        """Links between classes, of left nodes with right ones."""
        root = t.column("root").to_numpy()
        left = np.flatnonzero(t.column("left").to_numpy(zero_copy_only=False))
        right = np.flatnonzero(~t.column("left").to_numpy(zero_copy_only=False))
        links = connect(Sets(root.tolist()), root, signature_rows(t), t.column("text").combine_chunks(), left, right,
                        threshold)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    def relabelled(links: DataFrame) -> DataFrame:
        top = written(spark, few(components(links), 1), "tops").select(F.col("node").alias("root"), F.col("root").alias("top"))
        return large.join(top, "root", "left").select("cluster", "nb", "block", "node", "root",
                                                      F.coalesce("top", "root").alias("top"), "medoid")

    # the blocks' medoids first: they join what is one class over many blocks
    m = large.where("medoid").select("cluster", F.pmod(F.xxhash64("node"), F.ceil(F.col("nb") / BLOCK)).alias("part"),
                                     "node", "root")
    m = m.join(body, "node").withColumn("left", F.explode(F.array(F.lit(True), F.lit(False))))
    links = written(spark, few(m.groupBy("cluster", "part").applyInArrow(between, "a long, b long")), "links")
    now = written(spark, few(relabelled(links), 1), "large")
    main = (now.groupBy("cluster", "top").agg(F.count("*").alias("n")).groupBy("cluster")
            .agg(F.max_by("top", F.struct("n", "top")).alias("main")))
    # then every node outside its cluster's largest class with all nodes, block by block
    outside = now.join(main, "cluster").where("top <> main")
    chunks = outside.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("nc"))
    left = (outside.join(chunks, "cluster")
            .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("nc")))
            .select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("block"), "chunk",
                    "node", F.col("top").alias("root"), F.lit(True).alias("left")))
    right = now.join(chunks, "cluster").select(
        "cluster", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc") - 1)).alias("chunk"),
        "node", F.col("top").alias("root"), F.lit(False).alias("left"))
    more = left.unionAll(right).join(body, "node").groupBy("cluster", "block", "chunk").applyInArrow(between, "a long, b long")
    done = relabelled(links.unionAll(written(spark, few(more), "links")))
    return first.where("nb = 1").select("node", "root").unionAll(done.select("node", F.col("top").alias("root")))


def marked(rows: DataFrame, key) -> DataFrame:
    """The written set of a key: what is not in it need not be shuffled to meet ``rows``."""
    return written(rows.sparkSession, marks(rows, key, MARK_BITS).coalesce(4), "marks")


def find(docs: DataFrame, id_col: str, text_col: str, threshold: float, whole: bool):
    """(written rows by uid, (uid, doc_id, root) of each): rows of one ``root`` are one class.

    ``uid`` numbers the rows; a node is the least uid of the same words, a root the least of a class.
    """
    spark = docs.sparkSession
    rows = profiles(docs, id_col, text_col, whole).withColumn("uid", F.monotonically_increasing_id())
    rows = written(spark, few(rows), "profiles")
    real = rows.where("n > 0")
    words = F.xxhash64("k1", "k2")
    # rows whose words occur once are nodes as they are; only the others meet by their words
    copied = real.groupBy("k1", "k2").agg(F.min("uid").alias("node"), F.count("*").alias("c")).where("c > 1")
    copied = written(spark, few(copied.select("k1", "k2", "node"), 1), "copied")
    some = flagged(real.select("uid", "k1", "k2", "bands"), words, marked(copied, words), MARK_BITS, "again")
    twice = some.where("again").select("uid", "k1", "k2").join(copied, ["k1", "k2"], "left")
    member = written(spark, few(some.where("not again").select("uid", F.col("uid").alias("node")).unionAll(
        twice.select("uid", F.coalesce("node", "uid")))), "members")
    first = some.where("again").select("uid", "bands").join(
        member.where("uid = node").select("uid"), "uid", "left_semi")
    band = some.where("not again").select("uid", "bands").unionAll(first).select(
        F.col("uid").alias("node"), F.explode("bands").alias("key"))
    low = band.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    low = written(spark, few(low.select("key", "low"), 1), "buckets")
    shared = flagged(band, F.col("key"), marked(low, F.col("key")), MARK_BITS, "again").where("again")
    star = shared.join(low, "key").where("node <> low")
    cluster = written(spark, few(components(star.select(F.col("low").alias("a"), F.col("node").alias("b"))), 1), "clusters")
    size = cluster.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    of = cluster.join(size, "root").select("node", F.col("root").alias("cluster"), "nb",
                                           F.pmod(F.xxhash64("node"), F.col("nb")).alias("block"))
    texts = flagged(rows.select(F.col("uid").alias("node"), "text", "sig"), F.xxhash64("node"),
                    marked(of, F.xxhash64("node")), MARK_BITS, "in").where("`in`")
    candidates = written(spark, few(texts.join(of, "node").drop("in")), "candidates")
    root = written(spark, few(settle(candidates, threshold), 1), "roots")
    discard(candidates, cluster)
    found = member.join(root, "node", "left").select("uid", F.coalesce("root", "node").alias("root"))
    return rows, rows.select("uid", "doc_id").join(found, "uid", "left").select(
        "uid", "doc_id", F.coalesce("root", "uid").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size) per row; ``class_id`` is the least id of the class."""
    _, found = find(docs, id_col, text_col, threshold, False)
    found = written(docs.sparkSession, few(found), "classes")
    least = found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(least, "root").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id (a null id comes first)."""
    rows, found = find(docs, id_col, text_col, threshold, True)
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("k")).select(F.col("k.uid").alias("uid"))
    place = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return rows.join(kept, "uid", "left_semi").select(
        *(place.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
