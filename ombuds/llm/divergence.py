"""Divergence of the sources of each language, over collapsed texts.

Identical texts of one language are collapsed before any is tokenized: a text that occurs in
several documents becomes one row with its number of documents per source, and its terms are
counted once, weighted with those numbers. Texts that occur once need no grouping: the set of
repeated (language, SHA-256) keys is a bitmap of a fixed size (``marks``), so that only repeated
texts are shuffled, one copy a task.

Each term's smoothed share is ``p = 1 + floor(10^9 (n + 5) / (N + 5 V))``. Sources are compared by
the sum of ``abs(p - q)`` over all kept terms of the language. Only terms that at least one of two
sources has are visited: all others contribute the same difference of the two zero-count shares,
times their number. Terms are dealt into blocks of about ``CELLS`` terms x sources; a block
gives one partial sum a pair of sources, so no pair is emitted per term. Sums are 64-bit integers.

Defined results: null text, lang and source read as ''; a group without terms still takes part; a
language without kept terms has value 0 for its pairs and no terms; equal values are ranked by
item in UTF-8 order; repeated rows count as often as they occur; an empty table gives no rows.
Only the text, lang and source columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .marks import flagged, marks
from .words import Words, slices

#: A term is kept in a language where at least so many documents have it.
LEAST_DOCS = 30
SMOOTH, SCALE = 5, 1_000_000_000
TOP_TERMS = 50
#: Bits of the set of repeated texts (16 MB).
REPEAT_BITS = 1 << 27
#: Least and most terms x sources of a block, about (int64); between them four times the pairs of
#: sources, so that the partial sums are fewer than the counts.
CELLS, MOST_CELLS = 1 << 15, 1 << 22
#: Counts that a task holds before it hands them on.
HELD = 400_000

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:0x41] = _SEPARATOR[0x5B:0x61] = _SEPARATOR[0x7B:0x80] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


def terms_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each term occurrence, its code, the distinct terms) of a slice of texts."""
    w = Words(raw, off, _SEPARATOR)
    ink = _FOLD[raw[~_SEPARATOR[raw]]]  # terms only, one after the other
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(ends), pa.py_buffer(ink))
    coded = flat.dictionary_encode()
    return w.doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys and the integer sums of the values over each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def count_terms(batches):
    """Batches of (lang, text, sources array<struct<source, n>>) to (lang, source, term, n, docs)."""
    names = ["lang", "source", "term", "n", "docs"]
    held: list[pa.Table] = []
    rows = 0

    def total(tables):
        t = pa.concat_tables(tables).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.rename_columns(names).cast(pa.schema([(c, pa.string()) for c in names[:3]] + [(c, pa.int64()) for c in names[3:]]))

    for b in batches:
        lists = b.column(2)
        first = lists.offsets.to_numpy()
        first = first - first[0]
        each = lists.flatten()
        source = each.field("source").cast(pa.large_string()).dictionary_encode()
        lang = b.column(0).cast(pa.large_string()).dictionary_encode()
        lang_code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        source_code = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        times = each.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, raw, off in slices(b.column(1)):
            doc, code, term = terms_of(raw, off)
            if not len(doc):
                continue
            pair, (tf,) = summed(doc * len(term) + code, np.ones(len(doc), np.int64))
            doc, code = i + pair // len(term), pair % len(term)
            reps = (first[1:] - first[:-1])[doc]
            at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[:-1][doc], reps)
            group = lang_code[np.repeat(doc, reps)] * len(source.dictionary) + source_code[at]
            key, (n, docs) = summed(group * len(term) + np.repeat(code, reps), np.repeat(tf, reps) * times[at], times[at])
            group, code = key // len(term), key % len(term)
            held.append(pa.table([lang.dictionary.take(group // len(source.dictionary)),
                                  source.dictionary.take(group % len(source.dictionary)),
                                  term.take(code), n, docs], names=names))
            rows += len(key)
            if rows > HELD:
                yield from total(held).to_batches(max_chunksize=20_000)
                held, rows = [], 0
    if held:
        yield from total(held).to_batches(max_chunksize=20_000)


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, sources): each text of a language once, with its number of documents per source."""
    spark = docs.sparkSession
    key = F.xxhash64("lang", "sha")
    d = docs.select("lang", "source", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    narrow = written(spark, d.select("lang", "source", "sha"), "shas")
    times = narrow.groupBy("lang", "sha", "source").agg(F.count("*").alias("n"))
    repeated = narrow.groupBy("lang", "sha").count().where("count > 1")
    found = written(spark, marks(repeated, key, REPEAT_BITS).coalesce(4), "repeated")
    rows = flagged(d, key, found, REPEAT_BITS, "again")
    alone = rows.where("not again").select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("sources"))
    once = rows.where("again").groupBy("lang", "sha").agg(F.first("text").alias("text"))
    # a list has one entry a source that has the text
    lists = flagged(times, key, found, REPEAT_BITS, "again").where("again").groupBy("lang", "sha").agg(
        F.collect_list(F.struct("source", "n")).alias("sources"))
    return alone.unionAll(once.join(lists, ["lang", "sha"]).select("lang", "text", "sources"))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all terms: occurrences, and documents that have it."""
    rows = collapsed(docs).mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str):
    """The smoothed share; decimals, so that no count overflows."""
    wide = "cast({} as decimal(28, 0))".format
    return F.expr(f"1 + ({SCALE} * ({wide(n)} + {SMOOTH})) div ({wide(total)} + {SMOOTH} * {wide(kept)})")


def differ(key, left, right):
    """One block of terms: partial sums of each pair of sources."""
    lang = key[0].as_py()
    names = right.column("source").combine_chunks()
    size = len(names)
    rank = pc.rank(names, tiebreaker="first").to_numpy().astype(np.int64) - 1
    zero = np.zeros(size, np.int64)
    zero[rank] = right.column("zero").fill_null(0).to_numpy()
    ordered = names.take(pa.array(np.argsort(rank)))
    coded = left.column("term").combine_chunks().dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False)
    source = pc.index_in(left.column("source").combine_chunks(), ordered).to_numpy(zero_copy_only=False).astype(np.int64)
    p = np.tile(zero, (len(coded.dictionary), 1))
    p[term, source] = left.column("p").to_numpy()
    has = np.zeros(p.shape, bool)
    has[term, source] = True
    own, both, shared = np.zeros((3, size, size), np.int64)
    for s in range(size):
        rows = np.flatnonzero(has[:, s])
        far = np.abs(p[rows] - p[rows, s][:, None])
        own[s], both[s], shared[s] = far.sum(0), (far * has[rows]).sum(0), has[rows].sum(0)
    a, b = np.triu_indices(size, 1)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()),
                     "a": ordered.take(pa.array(a)).cast(pa.string()), "b": ordered.take(pa.array(b)).cast(pa.string()),
                     "far": (own + own.T - both)[a, b], "shared": shared[a, b]})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, every other source of the language;
    part ``term``, the terms that the source uses most beyond the language's share."""
    spark = docs.sparkSession
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                      for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    c = written(spark, counts(d), "counts")
    kept = written(spark, c.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                   .where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept")
    c = written(spark, c.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")

    groups = d.select("lang", "source").groupBy("lang", "source").agg(F.count("*").alias("rows"))
    per_lang = (groups.groupBy("lang").agg(F.count("*").alias("sources"))
                .join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left")
                .fillna(0, ["kept", "lang_total"]))
    totals = c.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    stats = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total", "terms"]).join(per_lang, "lang")
    cells = F.least(F.lit(MOST_CELLS), F.greatest(F.lit(CELLS), 4 * F.col("sources") * F.col("sources")))
    stats = written(spark, stats.select(
        "lang", "source", "total", "terms", "kept", "lang_total",
        F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / cells)).cast("int").alias("blocks"),
        F.when(F.col("kept") > 0, share("0", "total", "kept")).alias("zero")).coalesce(4), "stats")

    shares = c.join(stats, ["lang", "source"]).select(
        "lang", "source", "term", "blocks", share("n", "total", "kept").alias("p"),
        share("lang_n", "lang_total", "kept").alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        (F.col("p") - F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    entries = shares.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "source", "p")
    sides = stats.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "zero")
    part = entries.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(
        differ, "lang string, a string, b string, far long, shared long")
    part = part.groupBy("lang", "a", "b").agg(F.sum("far").alias("far"), F.sum("shared").alias("shared"))
    side = stats.select("lang", "source", "terms", "zero", "kept")
    part = (part.join(side.select("lang", F.col("source").alias("a"), F.col("terms").alias("ta"), F.col("zero").alias("za"), "kept"), ["lang", "a"])
            .join(side.select("lang", F.col("source").alias("b"), F.col("terms").alias("tb"), F.col("zero").alias("zb")), ["lang", "b"]))
    neither = F.col("kept") - F.col("ta") - F.col("tb") + F.col("shared")
    value = F.col("far") + F.coalesce(neither * F.abs(F.col("za") - F.col("zb")), F.lit(0))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = part.select("lang", value.alias("value"), ends.alias("e")).select(
        "lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    pair = pair.withColumn("rank", F.row_number().over(order))
    return pair.unionByName(term)
