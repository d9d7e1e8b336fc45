"""A training corpus from ``documents``: five stages, each written and read again.

1. toxicity: documents scored 0.5 or more go;
2. quality: documents scored under 0.3 go;
3. near-duplicates: one document of each class stays, the one with the least doc_id;
4. substring dedup: words of passages that also start earlier go, documents stay;
5. packing: what is left, in sequences of 2048 tokens, one row per piece.

The classifiers learn from the labelled rows of ``sf_dir`` outside the held-out fold, whatever
the documents of a stage. All stages but the last return the columns of their documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ombuds.llm import minhash, packing, quality_model, substring, toxicity
from ombuds.llm.queries import labelled
from ombuds.session import few, shared_dir
from ombuds.sources.tables import table

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.train(table(spark, sf_dir, "documents"), labelled(spark, sf_dir, "toxic"))
    return docs.where(toxicity.score(F.col("text"), net) < 0.5)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.train(table(spark, sf_dir, "documents"), labelled(spark, sf_dir, "quality"))
    return docs.where(quality_model.score(F.col("text"), model) >= 0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few(minhash.keep_one(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = few(substring.cleaned(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset", "ids")


STAGES = [("toxicity", clean_of_toxic), ("quality", good_quality), ("near_dedup", one_of_each),
          ("substring_dedup", without_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
