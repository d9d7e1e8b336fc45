"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import table
from . import (bpe, divergence, exact_dedup, langid, minhash, packing, quality_model, quality_rules, spelling,
               substring, topk, toxicity, url_filter)


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing of all documents; one row per piece."""
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                      "doc_tokens", "sequence_id", "offset")


def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of all documents: the least doc_id of the class."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words removed from all documents."""
    out = substring.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of all documents: base counts and verdict."""
    out = quality_rules.clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "clean_chars")


def labelled(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))
    return rows.where(fold(F.col("doc_id"), 5) != 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    docs = table(spark, sf_dir, "documents")
    known = written(spark, quality_model.stats(docs), "stats")
    model = quality_model.train(docs, labelled(spark, sf_dir, "quality"), known=known)
    out = quality_model.score_stats(known, model)
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and the bytes they decode to, as digests."""
    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, *how, raw="raw", decoded="decoded", drop_text=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("raw", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, labelled(spark, sf_dir, "toxic"))
    out = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
                      toxicity.score(F.col("text"), net).alias("score"))
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation for all pages. A page's labelled outcome is the ``labels`` row
    that bears its id: bad if the quality is 0 or it is toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), bad.cast("int").alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; counts and calibration come from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    out = langid.learn_and_identify(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of each 50th vector among all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents: which row stays, and the digest of every text."""
    return exact_dedup.classes(table(spark, sf_dir, "documents"), digests=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent near word that each is a form of."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that set each one off."""
    return divergence.audit(table(spark, sf_dir, "documents"))


REGISTRY = {f.__name__: f for f in (
    op1_packing, op2_probminhash, op3_fm_index, op4_line_first, op5_quality_classifier, op6_byte_bpe,
    op7_toxicity, op8_host_reputation, op9_language_id, op10_pivot_topk, op11_exact_dedup,
    op12_spelling_variants, op13_source_divergence)}
