"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each text becomes a vector of statistics (lengths, shares of symbols, capitals, separators,
repeated words, lines and five-word windows). Standardised, they are mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel. Each partition sums its part
of the normal equations; the driver adds the parts, of fixed size, and solves the ridge.
Isotonic regression over scores of rows that were left out (two halves, crossed) turns them
into probabilities; it sees counts by score bin, not rows.

Defined results: a null or empty text has all statistics 0 and is scored as such; rows
without a label teach nothing; without any labelled row every score is 0.5. Repeated rows are
judged each. Other columns than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, grams, inside, slices

FEATURES = 256
WIDTH = 3.0
RIDGE = 1.0
SEED = 11
#: Partitions that sum the normal equations, and so the matrices that reach the driver.
SUM_PARTS = 16
BINS = 2000

_SYMBOL, _BAR, _UPPER, _LOWER, _DIGIT, _CRY, _STOP, _LINE, _HIGH = range(9)
_CLASS = np.full(256, 9, np.int64)
for _k, _chars in ((_SYMBOL, "#*$%&<>"), (_BAR, "|"), (_CRY, "!?"), (_STOP, ".,;:"), (_LINE, "\n"),
                   (_DIGIT, "0123456789"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                   (_LOWER, "abcdefghijklmnopqrstuvwxyz")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:] = _HIGH
STATS = 16


def repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of values that repeat an earlier one, share of the most frequent value) by text."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    of = (key[at] >> np.uint64(44)).astype(np.int64)
    run = np.diff(np.append(at, len(key)))
    total = np.bincount(of, run, n)
    most = np.zeros(n)
    np.maximum.at(most, of, run)
    some = np.maximum(total, 1)
    return 1 - np.bincount(of, minlength=n) / some * (total > 0) - (total == 0), most / some


def slice_stats(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[texts, STATS] statistics of the texts of a slice."""
    n = len(off) - 1
    kinds = _CLASS[raw]
    size = np.diff(off)
    doc_of_byte = np.repeat(np.arange(n), size)
    share = np.bincount(doc_of_byte * 10 + kinds, minlength=10 * n).reshape(n, 10).astype(float)
    words = Words(raw, off)
    count = words.count.astype(float)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(words.doc, length, n) / some
    sd = np.sqrt(np.maximum(0, np.bincount(words.doc, length ** 2, n) / some - mean ** 2))
    h = words.hashes()
    again, top = repeats(words.doc, h, n)
    g, ok = grams(h, 5), inside(words.first, 5)
    again5, _ = repeats(words.doc[:len(g)][ok], g[ok], n)
    lines = Words(raw, off, _NEWLINE)
    again_line, _ = repeats(lines.doc, lines.hashes(), n)
    ink = np.maximum(1, np.bincount(words.doc, length, n))
    letters = np.maximum(1, share[:, _UPPER] + share[:, _LOWER] + share[:, _HIGH])
    out = np.stack([
        np.log1p(count), np.log1p(mean), np.log1p(sd), share[:, _SYMBOL] / ink, share[:, _BAR] / some,
        share[:, _UPPER] / letters, share[:, _DIGIT] / ink, share[:, _CRY] / some, share[:, _STOP] / some,
        share[:, _LINE] / some, share[:, _HIGH] / ink, again, top, again5, again_line,
        np.log1p(count / np.maximum(1, lines.count))], 1)
    out[count == 0] = 0
    # shares of rare kinds matter most near zero
    for k in (3, 4, 7, 13, 14):
        out[:, k] = np.sqrt(np.maximum(out[:, k], 0))
    return np.nan_to_num(out)


_NEWLINE = np.zeros(256, bool)
_NEWLINE[ord("\n")] = True


def column_stats(col) -> np.ndarray:
    parts = [slice_stats(raw, off) for _, _, raw, off in slices(col)]
    return np.concatenate(parts) if parts else np.zeros((0, STATS))


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) per row."""
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            x = column_stats(b.column(1))
            if len(x):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATS, np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "x"])

    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, x array<double>")


class Model:
    """Standardisation, random projection, ridge weights and the calibration's steps."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.maximum(sd, 1e-3)
        self.w = rng.standard_normal((STATS, FEATURES)) / WIDTH
        self.b = rng.random(FEATURES) * 2 * np.pi
        self.weights = np.zeros((3, FEATURES + 1))  # all rows, first half, second half
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        f = np.sqrt(2.0 / FEATURES) * np.cos(z @ self.w + self.b)
        return np.concatenate([f, np.ones((len(f), 1))], 1)

    def raw(self, x: np.ndarray, which: int = 0) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights[which], -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.x, self.y)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted least squares fit to y, in the order of x (pool adjacent violators)."""
    level, weight, size = [], [], []
    for v, m in zip(y[np.argsort(x, kind="stable")], w[np.argsort(x, kind="stable")]):
        level.append(v)
        weight.append(m)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            v2, m2, s2 = level.pop(), weight.pop(), size.pop()
            level[-1] = (level[-1] * weight[-1] + v2 * m2) / (weight[-1] + m2)
            weight[-1] += m2
            size[-1] += s2
    return np.repeat(level, size)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          known: DataFrame | None = None) -> Model:
    """Model from rows (id, ``label`` 0/1). ``known``: the statistics of ``docs``, if at hand.

    Texts are never shuffled: only their statistics are joined with the labels.
    """
    spark = docs.sparkSession
    label = (labels.where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("key")).agg(F.min("label").cast("double").alias("label")))
    rows = (stats(docs, id_col, text_col) if known is None else known)
    rows = rows.join(label, F.col("id") == F.col("key")).select("x", "label", (F.xxhash64("id") % 2 == 0).alias("half"))
    from ..session import written
    rows = written(spark, rows, "quality-rows")
    at = [F.element_at("x", i + 1) for i in range(STATS)]
    m = rows.agg(F.count("*"), *(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
    if not m[0]:
        return Model(np.zeros(STATS), np.ones(STATS))
    model = Model(np.array(m[1:1 + STATS]), np.array(m[1 + STATS:]))

    def equations(batches):
        size = FEATURES + 1
        a, v = np.zeros((2, size, size)), np.zeros((2, size))
        for b in batches:
            f = model.features(np.stack(b.column(0).to_numpy(zero_copy_only=False)))
            y, half = np.asarray(b.column(1)), np.asarray(b.column(2)).astype(int)
            for k in (0, 1):
                a[k] += f[half == k].T @ f[half == k]
                v[k] += f[half == k].T @ y[half == k]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([v.tobytes()])], names=["a", "v"])

    parts = rows.repartition(SUM_PARTS).mapInArrow(equations, "a binary, v binary").collect()
    a = sum(np.frombuffer(p.a).reshape(2, FEATURES + 1, -1) for p in parts)
    v = sum(np.frombuffer(p.v).reshape(2, -1) for p in parts)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    for k, (left, right) in enumerate(((a.sum(0), v.sum(0)), (a[0], v[0]), (a[1], v[1]))):
        model.weights[k] = np.linalg.solve(left + penalty, right)

    def left_out(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False))
                half = np.asarray(b.column(2)).astype(bool)
                s = np.where(half, model.raw(x, 1), model.raw(x, 2))  # each half by the other's weights
                yield pa.RecordBatch.from_arrays([pa.array(np.floor((s + 1) * BINS / 3).astype(np.int64)), b.column(1)],
                                                 names=["bin", "label"])

    bins = (rows.mapInArrow(left_out, "bin long, label double").groupBy("bin")
            .agg(F.avg("label").alias("y"), F.count("*").alias("n")).toPandas())
    x = (bins["bin"].to_numpy() + 0.5) * 3 / BINS - 1
    order = np.argsort(x)
    level = isotonic(x, bins["y"].to_numpy(float), bins["n"].to_numpy(float))
    model.x, model.y = x[order], np.clip(level, 0.0, 1.0)
    return model


def score(text: Column, model: Model) -> Column:
    """Column of the score of each whole text."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(column_stats(texts)))

    return run(text.cast("string"))


def score_stats(known: DataFrame, model: Model) -> DataFrame:
    """(id, score) from rows of ``stats``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = model.score(np.stack(b.column(1).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["id", "score"])

    return known.mapInArrow(run, f"id {known.schema['id'].dataType.simpleString()}, score double")
