"""Language identification with interpolated Kneser-Ney character models.

Every language has a character 4-gram model. Counts of all grams of all training texts,
continuation counts, discounts, context totals and back-off weights are tables that Spark sums
from one another; none is cut. The distinct grams of the texts to be judged are joined with
them, which gives each gram its log probability in every language. That table is searched as
sorted arrays of 64-bit gram keys (four symbols of 16 bits), one key range of at most
``RANGE_BYTES`` after the other: a text's sums over the ranges are added. A text gets the
language with the lowest cross-entropy per symbol. Lower case is used, every run of
non-letters is one space, and a letter beyond U+FFFF is two symbols, its UTF-16 units.

The score is the share of the chosen language in the softmax of the negated cross-entropies,
lowered for texts whose cross-entropy is beyond what the language's own texts show
(median and spread over all distinct training texts); ``rejected`` marks those far out.

Defined results: a null text or one without a letter gets ``und`` and score 0; rows without
a language teach nothing; without any training row every text is ``und``. Repeated rows are
judged each. Only the id, text and language columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .words import slices

ORDER = 4
BITS = np.uint64(16)
SPACE = 32
#: Memory of one key range of the gram table; larger tables take several passes over the texts.
RANGE_BYTES = 64 << 20
#: Bits of the steps in which medians are sought: counts per step, then those of the middle step in finer ones.
STEP_BITS = (12, 26, 40)
SHARPNESS = 8.0
#: Spreads above the mean cross-entropy from which the score falls, and from which a text is rejected.
FAR, REJECT = 3.0, 8.0


@functools.lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Lower-case code point of each letter, a space for all else."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def text_symbols(raw: np.ndarray, off: np.ndarray):
    """(symbols of all texts of a slice, text of each symbol); every text starts with a space."""
    marks = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(marks))
    sym = symbols()[points]
    n = len(off) - 1
    sym = np.insert(sym, marks[:-1], SPACE)
    doc = np.insert(doc, marks[:-1], np.arange(n))
    blank = sym == SPACE
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
    sym, doc = sym[keep], doc[keep]
    wide = sym > 0xFFFF
    if wide.any():
        first = np.flatnonzero(wide) + np.arange(wide.sum())
        sym, doc = np.repeat(sym, 1 + wide), np.repeat(doc, 1 + wide)
        rest = sym[first] - 0x10000
        sym[first], sym[first + 1] = 0xD800 + (rest >> 10), 0xDC00 + (rest & 0x3FF)
    return sym.astype(np.uint64), doc


def suffix_mask(k: int) -> int:
    """Bits of the last k symbols of a gram, as a signed number of 64 bits."""
    return (1 << int(BITS) * k) - 1 if k < ORDER else -1


def text_grams(raw: np.ndarray, off: np.ndarray):
    """(gram keys, their text) of all ``ORDER``-grams of the texts of a slice."""
    return symbol_grams(*text_symbols(raw, off))


def symbol_grams(sym: np.ndarray, doc: np.ndarray):
    m = len(sym) - ORDER + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = sym[:m].copy()
    for i in range(1, ORDER):
        key = (key << BITS) | sym[i:i + m]
    same = doc[:m] == doc[ORDER - 1:]
    return key[same], doc[:m][same]


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text); each task sums before it sends."""

    def run(batches):
        have: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in have.items():
                key, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.astype(np.int64)),
                                                  pa.array(n)], names=["lang", "gram", "n"])
            have.clear()

        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            for i, j, raw, off in slices(b.column(1)):
                key, doc = text_grams(raw, off)
                names, code = np.unique(lang[i:j].astype(str), return_inverse=True)
                of = code[doc]
                for k, name in enumerate(names):
                    u, n = np.unique(key[of == k], return_counts=True)
                    have.setdefault(name, []).append((u, n))
                    size += len(u)
            if size > 3_000_000:
                have = {name: [merged(parts)] for name, parts in have.items()}
                size = sum(len(p[0][0]) for p in have.values())
                if size > 2_000_000:
                    yield from out()
                    size = 0
        yield from out()

    part = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)


class KneserNey:
    """One language on one machine: per order, sorted keys with probabilities and contexts with
    back-off weights. The plain form of ``Models``, which tests compare the tables with."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        key, count = gram[order], n[order].astype(float)
        tables = [(key, count)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols precede a gram
            mask = np.uint64(suffix_mask(k))
            u, c = np.unique(tables[-1][0] & mask, return_counts=True)
            tables.append((u, c.astype(float)))
        tables.reverse()
        self.size = len(tables[0][0]) + 1
        self.keys, self.prob, self.ctx, self.back = [], [], [], []
        for k, (key, count) in enumerate(tables, 1):
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx, at = np.unique(key >> BITS, return_inverse=True)
            total = np.bincount(at, count, len(ctx))
            back = d * np.bincount(at, minlength=len(ctx)) / total
            if k == 1:
                lower = np.full(len(key), 1.0 / self.size)
            else:
                lower = self.at(key & np.uint64(suffix_mask(k - 1)), k - 1)
            self.keys.append(key)
            self.prob.append((count - d) / total[at] + back[at] * lower)
            self.ctx.append(ctx)
            self.back.append(back)

    def at(self, key: np.ndarray, k: int) -> np.ndarray:
        """Probability of the last symbol of each k-gram key after its context."""
        if k == 0:
            return np.full(len(key), 1.0 / self.size)
        where, found = find(self.keys[k - 1], key)
        out = np.empty(len(key))
        out[found] = self.prob[k - 1][where[found]]
        rest = ~found
        if rest.any():
            miss = key[rest]
            c, seen = find(self.ctx[k - 1], miss >> BITS)
            weight = np.where(seen, self.back[k - 1][c], 1.0)
            out[rest] = weight * self.at(miss & np.uint64(suffix_mask(k - 1)), k - 1)
        return out


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether found) of each x in sorted ``keys``."""
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def entries(*cols: str):
    return F.collect_list(F.struct("l", *cols)).alias("e")


class Models:
    """All languages: per order, the counts of each gram and the (types, total) of each context."""

    def __init__(self, counts: DataFrame, langs: list[str]):
        self.langs = langs
        spark = counts.sparkSession
        number = spark.createDataFrame(list(zip(langs, range(len(langs)))), "lang string, l int")
        table = counts.join(F.broadcast(number), "lang").select("l", "gram", "n")
        self.grams, self.contexts = {}, {}
        self.discount = np.full((ORDER + 1, len(langs)), 0.5)
        for k in range(ORDER, 0, -1):
            if k < ORDER:  # continuation counts: how many symbols precede a gram
                suffix = F.col("gram").bitwiseAND(F.lit(suffix_mask(k)).cast("long"))
                table = table.groupBy("l", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
                table = written(spark, table, f"grams{k}")
            ones = table.groupBy("l").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"),
                                          F.count(F.lit(1)).alias("types"), F.sum("n").alias("total")).collect()
            for r in ones:
                if r.n1 and r.n2:
                    self.discount[k, r.l] = r.n1 / (r.n1 + 2 * r.n2)
            self.grams[k] = table.groupBy("gram").agg(entries("n"))
            if k > 1:
                ctx = F.shiftrightunsigned("gram", int(BITS)).alias("ctx")
                of = table.groupBy("l", ctx).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("total"))
                self.contexts[k] = of.groupBy("ctx").agg(entries("types", "total"))
        self.first = np.zeros((len(langs), 2))  # (types, total) of single symbols
        for r in ones:
            self.first[r.l] = r.types, r.total
        self.one = self.arrays(self.table(self.grams[1].select("gram"), 1))
        self.mean = np.full(len(langs), np.inf)
        self.sd = np.ones(len(langs))

    def table(self, wanted: DataFrame, order: int = ORDER) -> DataFrame:
        """(gram, lp): log probabilities in all languages of the distinct grams ``wanted``."""
        width, discount, first = len(self.langs), self.discount, self.first
        t = wanted
        for k in range(1, order + 1):
            key = F.col("gram").bitwiseAND(F.lit(suffix_mask(k)).cast("long"))
            of = self.grams[k].select(F.col("gram").alias("_g"), F.col("e").alias(f"g{k}"))
            t = t.join(F.broadcast(of) if k == 1 else of, key == F.col("_g"), "left").drop("_g")  # one row a symbol
            if k > 1:
                of = self.contexts[k].select(F.col("ctx").alias("_c"), F.col("e").alias(f"c{k}"))
                t = t.join(F.broadcast(of) if k == 2 else of, F.shiftrightunsigned(key, int(BITS)) == F.col("_c"), "left").drop("_c")

        def spread(col, name, n):
            """[rows, languages] of one field of the entries of each row; 0 where there is none."""
            out = np.zeros((n, width))
            row = np.asarray(pc.list_parent_indices(col))
            flat = pc.list_flatten(col)
            out[row, np.asarray(flat.field("l"))] = np.asarray(flat.field(name))
            return out

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                n = b.num_rows
                p = np.broadcast_to(1.0 / (first[:, 0] + 1), (n, width))
                for k in range(1, order + 1):
                    count = spread(b.column(f"g{k}"), "n", n)
                    if k == 1:
                        types, total = np.broadcast_to(first[:, 0], (n, width)), np.broadcast_to(first[:, 1], (n, width))
                    else:
                        types, total = spread(b.column(f"c{k}"), "types", n), spread(b.column(f"c{k}"), "total", n)
                    seen = total > 0
                    safe = np.where(seen, total, 1.0)
                    back = np.where(seen, discount[k] * types / safe, 1.0)
                    p = np.where(count > 0, count - discount[k], 0.0) / safe + back * p
                lp = pa.array(np.log(p).astype(np.float32).ravel())
                lp = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), lp)
                yield pa.RecordBatch.from_arrays([b.column("gram"), lp], names=["gram", "lp"])

        return t.mapInArrow(run, "gram long, lp array<float>")

    def arrays(self, table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their [keys, languages] log probabilities."""
        t = table.toArrow()
        key = t.column("gram").to_numpy().astype(np.uint64)
        lp = t.column("lp").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(key), len(self.langs))
        at = np.argsort(key)
        return key[at], lp[at]

    def ranges(self, texts: DataFrame) -> tuple[DataFrame, list]:
        """The table of all grams of ``texts`` and the key ranges that it is read by."""
        spark = texts.sparkSession
        grams = count_grams(texts.select(F.lit("").alias("lang"), "text").where("text is not null")).select("gram")
        table = written(spark, self.table(grams), "gram-logs")
        parts = -(-table.count() * (8 + 4 * len(self.langs)) // RANGE_BYTES)
        if parts <= 1:
            return table, [F.lit(True)]
        edges = table.agg(F.percentile_approx("gram", [i / parts for i in range(1, parts)], 10_000).alias("e")).first().e
        edges = sorted(set(edges))
        return table, [(F.lit(True) if i == 0 else F.col("gram") > edges[i - 1])
                       & (F.lit(True) if i == len(edges) else F.col("gram") <= edges[i]) for i in range(len(edges) + 1)]

    def sums(self, rows: DataFrame) -> DataFrame:
        """(tag, total, grams, letters) per row (tag, text): log probability sums in all languages, the symbols that they
        are over (0 if there is no letter), and whether there is a letter."""
        spark = rows.sparkSession
        table, ranges = self.ranges(rows)
        schema = f"tag {rows.schema['tag'].dataType.simpleString()}, total array<double>, grams long, letters boolean"
        if len(ranges) == 1:
            return rows.mapInArrow(self.scorer(self.arrays(table), spark, True), schema)
        rows = written(spark, rows.withColumn("rid", F.monotonically_increasing_id()), "texts")
        parts = None
        for i, of in enumerate(ranges):
            run = self.scorer(self.arrays(table.where(of)), spark, i == 0, i)
            part = written(spark, rows.select("tag", "text", "rid").mapInArrow(run, schema + ", rid long, part int"), "sums")
            parts = part if parts is None else parts.unionByName(part)
        first = F.col("part") == 0
        return parts.groupBy("rid").agg(
            F.max_by("tag", F.when(first, 1)).alias("tag"),
            F.array(*[F.sum(F.col("total")[i]) for i in range(len(self.langs))]).alias("total"),
            F.max("grams").alias("grams"), F.max("letters").alias("letters")).drop("rid")

    def calibrate(self, sums: DataFrame) -> None:
        """Median and spread of the cross-entropy of each language's own texts, from the ``sums`` of all of them under
        tags (lang, mark); texts of one mark count once."""
        own = F.array_position(F.array(*[F.lit(x) for x in self.langs]), F.col("tag.lang")).cast("int")
        h = -F.get("total", own - 1) / F.greatest("grams", F.lit(1))
        texts = sums.where("letters and tag.lang is not null").select((own - 1).alias("own"), "tag.mark", h.alias("v"))
        texts = written(sums.sparkSession, texts.groupBy("own", "mark").agg(F.min("v").alias("v")), "entropies")
        mean, n = medians(texts, len(self.langs))
        off = F.abs(F.col("v") - F.get(F.array(*[F.lit(float(x)) for x in mean]), F.col("own"))).alias("v")
        spread, _ = medians(texts.select("own", off), len(self.langs))
        some = n >= 5
        self.mean[some], self.sd[some] = mean[some], np.maximum(0.05, 1.4826 * spread[some])

    def scorer(self, arrays, spark, first: bool, part: int | None = None):
        """A function over batches (tag, text, ...) that adds up what one key range knows; the first range has the
        texts that are shorter than the order, by the unigram model."""
        shared, one, width = spark.sparkContext.broadcast(arrays), self.one, len(self.langs)

        def totals(raw, off):
            keys, lp = shared.value
            n = len(off) - 1
            sym, of = text_symbols(raw, off)
            letters = np.bincount(of[sym != SPACE], minlength=n) > 0
            key, doc = symbol_grams(sym, of)
            grams = np.bincount(doc, minlength=n)
            total = np.zeros((n, width))
            if len(keys) and len(key):
                at, found = find(keys, key)
                at, doc = at[found], doc[found]
                for k in range(width):
                    total[:, k] = np.bincount(doc, lp[at, k], n)
            short = np.flatnonzero(letters & (grams == 0))
            for d in short:  # fewer symbols than the order
                own = sym[of == d]
                grams[d] = len(own)
                if first:
                    at, found = find(one[0], own)
                    other = np.log(unseen)
                    total[d] = np.where(found[:, None], one[1][at], other).sum(0)
            return total, grams, letters

        unseen = self.discount[1] * self.first[:, 0] / self.first[:, 1] / (self.first[:, 0] + 1)

        def run(batches):
            for b in batches:
                got = [totals(raw, off) for _, _, raw, off in slices(b.column(1))]
                if got:
                    total, grams, letters = (np.concatenate(x) for x in zip(*got))
                    n = b.num_rows
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(total.ravel()))
                    cols, names = [b.column(0), lists, pa.array(grams.astype(np.int64)), pa.array(letters)], ["tag", "total", "grams", "letters"]
                    if part is not None:
                        cols, names = [*cols, b.column(2), pa.array(np.full(n, part, np.int32))], [*names, "rid", "part"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        return run


def medians(values: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(median, count) of ``v`` in each group ``own``, right to 2**-40; 0 where there is none.

    The driver gets counts per step: of all values in coarse steps, then of those in the one or two
    steps that hold the middle, in finer ones, 2**14 a step at most."""
    out, total, below = np.zeros(groups), np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    rows = values
    for bits in STEP_BITS:
        step = F.floor(F.col("v") * 2.0 ** bits)
        t = rows.groupBy("own", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("own", "step").toArrow()
        own, at, n = (t.column(c).to_numpy() for c in ("own", "step", "n"))
        inside = F.lit(False)
        for g in np.unique(own):
            upto = np.cumsum(n[own == g])
            total[g] = total[g] or upto[-1]
            ends = np.searchsorted(upto, np.array([(total[g] + 1) // 2, total[g] // 2 + 1]) - below[g])
            below[g] += upto[ends[0]] - n[own == g][ends[0]]
            middle = at[own == g][ends]
            out[g] = (middle.mean() + 0.5) / 2.0 ** bits
            inside = inside | ((F.col("own") == int(g)) & step.isin([int(x) for x in middle]))
        rows = rows.where(inside)
    return out, total


def judge(h: np.ndarray, letters: np.ndarray, mean: np.ndarray, sd: np.ndarray):
    """(language number or -1, score, rejected) per row of cross-entropies; ties go to the first language."""
    best = h.argmin(1)
    low = h[np.arange(len(h)), best]
    share = 1.0 / np.exp(-SHARPNESS * (h - low[:, None])).sum(1)
    far = (low - mean[best]) / sd[best]
    score = share * np.exp(-np.maximum(0.0, far - FAR) / FAR)
    return np.where(letters, best, -1), np.where(letters, score, 0.0), letters & (far > REJECT)


def entropies(total, grams, width: int) -> np.ndarray:
    """[rows, languages] cross-entropy per symbol from the columns of ``Models.sums``."""
    lists = total.combine_chunks() if isinstance(total, pa.ChunkedArray) else total
    flat = np.asarray(lists.flatten()).reshape(-1, width)
    return -flat / np.maximum(np.asarray(grams), 1)[:, None]


def mark(text_col: str):
    """Tells texts apart, so that copies count once in the calibration."""
    return F.xxhash64(F.col(text_col).cast("string")).alias("mark")


def train(rows: DataFrame, calibrated: bool = True) -> Models | None:
    """Models from rows (lang, text) with a language; None without any.

    The driver gets four numbers per language and order, the single symbols, and the counts of
    ``medians``, for which all texts are scored. Without ``calibrated`` the caller does that.
    """
    rows = rows.where("lang is not null")
    spark = rows.sparkSession
    counts = written(spark, count_grams(rows.where("text is not null")), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    models = Models(counts, langs)
    if calibrated:
        models.calibrate(models.sums(rows.where("text is not null").select(F.struct("lang", mark("text")).alias("tag"), "text")))
    return models


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row."""
    few = docs.select(F.col(id_col).alias("tag"), F.col(text_col).cast("string").alias("text"))
    return judged(models.sums(few), models) if models else undecided(few)


def learn_and_identify(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """``identify`` of all rows by the models of those that ``learn`` (a boolean Column) holds for: one pass over the
    texts scores them and calibrates."""
    lang = F.when(learn, F.col(lang_col).cast("string"))
    text = F.col(text_col).cast("string").alias("text")
    models = train(docs.select(lang.alias("lang"), text), calibrated=False)
    if models is None:
        return undecided(docs.select(F.col(id_col).alias("tag"), text))
    tag = F.struct(F.col(id_col).alias("id"), lang.alias("lang"), mark(text_col)).alias("tag")
    sums = written(docs.sparkSession, models.sums(docs.select(tag, text)), "sums")
    models.calibrate(sums)
    return judged(sums.withColumn("tag", F.col("tag.id")), models)


def undecided(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("tag").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                       F.lit(False).alias("rejected"))


def judged(sums: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) from the ``sums`` of rows tagged by their ids."""
    names, width = np.array([*models.langs, "und"], object), len(models.langs)
    mean, sd = models.mean, models.sd

    def run(batches):
        for b in batches:
            if b.num_rows:
                best, score, far = judge(entropies(b.column(1), b.column(2), width), np.asarray(b.column(3)), mean, sd)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(far)],
                    names=["doc_id", "lang_pred", "score", "rejected"])

    kind = sums.schema["tag"].dataType.simpleString()
    return sums.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
