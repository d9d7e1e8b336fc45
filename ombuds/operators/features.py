"""Text features as Spark jobs: hashed TF-IDF embeddings (M1) and the TF-IDF
n-gram vocabulary / idf table (M6).

Tokens are maximal runs of letters, digits and '_' of length >= 2, lower-cased
(the ``\\b\\w\\w+\\b`` rule written with explicit classes, so the JVM and other
regex engines agree).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import written

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def _joiner(n: int):
    def join(x: Column) -> Column:
        return F.concat_ws(" ", *[x[str(j)] for j in range(n)])
    return join


def ngrams(tok: Column, n_max: int = 3) -> Column:
    """1..n_max word n-grams joined by a space, in sklearn's order (all 1-grams,
    then 2-grams, ...). Built from shifted slices zipped together, so the token
    array is referenced a fixed number of times (not once per position)."""
    parts = [tok]
    for n in range(2, n_max + 1):
        m = F.size(tok) - n + 1
        shifted = [F.slice(tok, j + 1, F.greatest(m, F.lit(0))) for j in range(n)]
        zipped = F.arrays_zip(*shifted)  # array<struct<0, 1, ...>>
        parts.append(F.when(F.size(tok) >= n, F.transform(zipped, _joiner(n))).otherwise(F.array()))
    return F.concat(*parts)


def token_text(col) -> Column:
    """The tokens joined by a space, which none of them holds: one string is sent to Python workers much faster
    than a list."""
    return F.array_join(tokens(col), " ")


#: Rows and bytes that are turned into numbers at once; a longer text is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 4096, 8 << 20


def pieces(texts: pa.Array):
    """(first row, slice) of a column of ``token_text``, of bounded size."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PIECE_BYTES, "right"))
        j = max(i + 1, min(j, i + PIECE_ROWS))
        yield i, texts.slice(i, j - i)
        i = j


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, number of each token among them, its row) of a piece."""
    lists = pc.split_pattern(texts, " ")
    token, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(token), 0)  # a text without tokens is split into one empty one
    coded = token.filter(some).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), row[some.to_numpy(zero_copy_only=False)]


# ---- M1: encoders ---------------------------------------------------------------------
# An encoder has ``fit(df, text_col)`` -> fitted; a fitted one has ``name``, ``dims``,
# ``encode(df, text_col, out_col)``, ``save(path)`` and ``state()`` (small, for the metadata).
class HashedEncoder:
    """Tokenizer -> HashingTF -> IDF -> L2 normaliser of MLlib. No model download."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def fit(self, corpus: DataFrame, text_col: str) -> "FittedHashed":
        pipe = Pipeline(stages=[
            RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=TOKEN_PATTERN,
                           gaps=False, toLowercase=True, minTokenLength=2),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=self.dims),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit", p=2.0)])
        return FittedHashed(pipe.fit(corpus.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))), self.dims)


class FittedHashed:
    name = "hashing-tf-idf"

    def __init__(self, model: PipelineModel, dims: int):
        self.model, self.dims = model, dims

    def encode(self, df: DataFrame, text_col: str, out_col: str = "vec") -> DataFrame:
        """Unit vectors as ARRAY<DOUBLE> (``dims`` entries); null where the text is null."""
        t = self.model.transform(df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))))
        vec = F.when(F.col(text_col).isNotNull(), vector_to_array("_unit"))
        return t.withColumn(out_col, vec).drop("_text", "_tok", "_tf", "_idf", "_unit")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def state(self) -> dict:
        return {"kind": "hashed", "dims": self.dims}


def bucket_counts(texts: pa.Array, dims: int) -> np.ndarray:
    """[rows, dims]: tokens of each bucket, by the first 4 bytes of the md5 of each distinct token,
    modulo ``dims``."""
    names, token, row = numbered(texts)
    md5 = (hashlib.md5(w).digest() for w in names.cast(pa.binary()).to_pylist())
    bucket = np.array([int.from_bytes(d[:4], "big") % dims for d in md5], np.int64)
    return np.bincount(row * dims + bucket[token], minlength=len(texts) * dims).reshape(len(texts), dims)


class Md5Encoder:
    """Token buckets by md5 (any SQL engine computes the same), IDF, L2 norm."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def fit(self, corpus: DataFrame, text_col: str) -> "FittedMd5":
        dims = self.dims

        def run(batches):
            df, n = np.zeros(dims, np.int64), 0
            for b in batches:
                for _, texts in pieces(b.column(0)):
                    df += (bucket_counts(texts, dims) > 0).sum(0)
                n += b.num_rows
            yield pa.RecordBatch.from_pydict({"b": np.arange(-1, dims, dtype=np.int32), "n": np.concatenate([[n], df])})

        found = corpus.select(token_text(text_col).alias("w")).mapInArrow(run, "b int, n long")
        df = {r.b: r.n for r in found.groupBy("b").agg(F.sum("n").alias("n")).collect()}  # dims + 1 rows
        n = df.get(-1, 0)
        return FittedMd5(dims, [math.log((n + 1) / (df.get(b, 0) + 1)) for b in range(dims)])


class FittedMd5:
    name = "md5-tf-idf"

    def __init__(self, dims: int, idf: list[float]):
        self.dims, self.idf = dims, idf

    def encode(self, df: DataFrame, text_col: str, out_col: str = "vec") -> DataFrame:
        """Unit vectors as ARRAY<DOUBLE>; null where the text is null, zero without tokens."""
        dims, idf = self.dims, np.array(self.idf)

        @F.arrow_udf("array<double>")
        def weigh(rows: pa.Array) -> pa.Array:
            out = []
            for _, texts in pieces(rows):
                v = bucket_counts(texts, dims) * idf
                n = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.divide(v, n, out=v, where=n > 0)
                known = texts.is_valid().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(known * dims)])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[known].ravel()), mask=texts.is_null()))
            return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

        return df.withColumn(out_col, weigh(token_text(text_col)))

    def save(self, path: str) -> None:
        """Nothing beside ``state``: the weights are a number per dimension."""

    def state(self) -> dict:
        return {"kind": "md5", "dims": self.dims, "idf": self.idf}


def load_encoder(spark: SparkSession, path: str, state: dict):
    """A fitted encoder from what ``save`` and ``state`` left."""
    if state["kind"] == "md5":
        return FittedMd5(state["dims"], state["idf"])
    return FittedHashed(PipelineModel.load(path), state["dims"])


# ---- M6 ----------------------------------------------------------------------------
#: Terms that a vocabulary may have to be sent to the tasks.
SENT_TERMS = 100_000


def gram_counts(texts: pa.Array, n_max: int, by_row: bool, among: pa.Array | None = None):
    """Counted 1..``n_max``-grams of a piece, per length: (term, row, occurrences, rows).

    ``by_row``: a term comes once per row that holds it, and ``row`` is its place; else once, with the number of rows
    that hold it. ``among``: only these terms. Tokens are numbered, an n-gram is numbered by the number of its first n - 1 tokens and its last."""
    names, token, row = numbered(texts)
    size, rows = max(1, len(names)), max(1, len(texts))
    gram, terms = token, names  # of the length before: number of the n-gram at each place, and their terms
    for n in range(1, n_max + 1):
        if n > 1:
            whole = row[:len(row) - n + 1] == row[n - 1:] if len(row) >= n else np.zeros(0, bool)
            places = np.flatnonzero(whole)
            distinct, number = np.unique(gram[places] * size + token[places + n - 1], return_inverse=True)
            terms = pc.binary_join_element_wise(terms.take(pa.array(distinct // size)), names.take(pa.array(distinct % size)), " ")
            gram = np.zeros(len(row), np.int64)
            gram[places] = number
        else:
            places = np.arange(len(row))
        if not len(places):
            return
        pairs = gram[places] * rows + row[places]
        if among is not None:
            pairs = pairs[pc.is_in(terms, value_set=among).to_numpy(zero_copy_only=False)[gram[places]]]
        held, tf = np.unique(pairs, return_counts=True)
        of = held // rows
        if by_row:
            yield terms.take(pa.array(of)), pa.array(held % rows), pa.array(tf), None
        else:
            yield (terms, None, pa.array(np.bincount(of, tf, len(terms)).astype(np.int64)),
                   pa.array(np.bincount(of, minlength=len(terms))))


def tfidf_vocabulary(docs: DataFrame, text_col: str, doc_id: str, max_features: int | None = 5000,
                     min_df: int = 2, max_df: float = 0.95, n_max: int = 3) -> DataFrame:
    """Vocabulary of a TF-IDF vectoriser with 1..3-grams: terms with document
    frequency >= ``min_df`` and <= ``max_df`` * #docs, the ``max_features`` most
    frequent across the corpus (ties by term), and smoothed idf
    ``ln((1 + n) / (1 + df)) + 1``.

    Each task counts the n-grams of its texts as numbers (``gram_counts``) and sends one row per distinct
    n-gram, so one shuffle on the term gives both counts; ``max_features`` None keeps every term."""
    n = docs.select(F.count(F.lit(1)).cast("double")).scalar()  # scalar subquery, stays in the plan

    def run(batches):
        for b in batches:
            for _, texts in pieces(b.column(0)):
                for term, _, tf, first in gram_counts(texts, n_max, by_row=False):
                    yield pa.RecordBatch.from_arrays([term, tf, first], names=["term", "tf", "df"])

    parts = docs.select(token_text(text_col).alias("w")).mapInArrow(run, "term string, tf long, df long")
    stats = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    if max_features is not None:
        kept = kept.orderBy(F.col("tf").desc(), F.col("term")).limit(max_features)
    return kept.select("term", "df", "tf",
                       (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def tfidf_vectors(docs: DataFrame, text_col: str, doc_id: str, vocabulary: DataFrame, n_max: int = 3) -> DataFrame:
    """M6: document vectors in long form ``(doc_id, term, weight)``: tf * idf over the
    vocabulary's terms, at L2 length 1 per document.

    The vocabulary is written. If it has at most ``SENT_TERMS`` terms, tasks leave out all others at once; the join
    does so in any case."""
    vocabulary = written(docs.sparkSession, vocabulary.select("term", "idf"), "vocabulary")
    few = vocabulary.count() <= SENT_TERMS
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.select("term").toArrow()["term"].combine_chunks() if few else None)

    def run(batches):
        for b in batches:
            for at, texts in pieces(b.column(1)):
                ids = b.column(0).slice(at, len(texts))
                for term, row, tf, _ in gram_counts(texts, n_max, True, sent.value):
                    yield pa.RecordBatch.from_arrays([ids.take(row), term, tf], names=["id", "term", "n"])

    texts = docs.select(F.col(doc_id).alias("id"), token_text(text_col).alias("w"))
    kind = texts.schema["id"].dataType.simpleString()
    grams = texts.mapInArrow(run, f"id {kind}, term string, n long").withColumnRenamed("id", doc_id)
    # rows of one id meet once: the sums and the lengths both follow this shuffle
    known = grams.join(vocabulary, "term").repartition(doc_id)
    tf = known.groupBy(doc_id, "term").agg((F.sum("n") * F.first("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_id)))
    return tf.select(doc_id, "term", (F.col("w") / norm).alias("weight"))
