"""Exact cosine top-k similarity join (J1, J2) and the neighbour vote.

Two plans:

* ``topk_in_set``: a reference set of bounded, checked size (see ``reference``) is broadcast as
  one normalised matrix. Queries stay where they are: ``mapInArrow`` multiplies each batch by
  it, in tiles. No shuffle and no count.
* ``similarity_topk``: references that grow with the data. Queries and references are hashed
  into blocks; each pair of blocks meets once in a ``cogroup``, which emits the local top-k
  per query, never the pairs. Blocks are bounded in rows, there are at least as many as
  cores, and a task multiplies tiles of a block. With several reference blocks a
  per-query window keeps the best ``k``. Only the two row counts that size the blocks reach
  the driver. Nothing is capped or sampled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .. import schema as S

TOPK_FIELDS = ["query_id", "rank", "ref_id", "ref_label", "similarity"]
TILE = 256


def unit_rows(vectors) -> np.ndarray:
    """Matrix of the vectors at length 1; a zero vector stays zero."""
    m = np.stack(vectors).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def tile_topk(q: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, similarities) [rows of q, k] by similarity, ties to the smaller column."""
    kk = min(k, len(r))
    picks, values = np.empty((len(q), kk), np.int64), np.empty((len(q), kk))
    for a in range(0, len(q), TILE):
        neg = -(q[a:a + TILE] @ r.T)
        part = np.argpartition(neg, kk - 1, axis=1)[:, :kk]
        vals = np.take_along_axis(neg, part, axis=1)
        best = np.take_along_axis(part, np.lexsort((part, vals), axis=1), axis=1)
        kth = vals.max(axis=1)
        for i in np.flatnonzero((neg <= kth[:, None]).sum(axis=1) > kk):  # ties at the k-th place
            cand = np.flatnonzero(neg[i] <= kth[i])
            best[i] = cand[np.lexsort((cand, neg[i, cand]))[:kk]]
        picks[a:a + TILE] = best
        values[a:a + TILE] = -np.take_along_axis(neg, best, axis=1)
    return picks, values


def _out_schema(query_type, ref_type, label_type) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_type), T.StructField("rank", T.IntegerType()),
                         T.StructField("ref_id", ref_type), T.StructField("ref_label", label_type),
                         T.StructField("similarity", T.DoubleType())])


def topk_in_set(queries: DataFrame, reference, k: int = S.KNN_K, query_id: str = "query_id",
                query_vec: str = "vec") -> DataFrame:
    """J1 against a ``reference.ReferenceSet``: output as ``similarity_topk``, no shuffle."""
    ids, labels, matrix = reference.arrays()
    shared = queries.sparkSession.sparkContext.broadcast((ids, labels, matrix))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec"))
    schema = _out_schema(q.schema["query_id"].dataType, reference.ref_type, T.StringType())

    def run(batches):
        ids, labels, matrix = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                if not part.num_rows or not len(ids):
                    continue
                at, sim = tile_topk(unit_rows(part.column(1).to_numpy(zero_copy_only=False)), matrix, k)
                row = np.repeat(np.arange(part.num_rows), at.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)),
                     pa.array(np.tile(np.arange(1, at.shape[1] + 1, dtype=np.int32), part.num_rows)),
                     ids.take(pa.array(at.ravel())), labels.take(pa.array(at.ravel())), pa.array(sim.ravel())],
                    names=TOPK_FIELDS)

    return q.mapInArrow(run, schema)


def _local_topk(k: int):
    def run(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(r) == 0:  # typed: an empty column of no type cannot become text
            return pd.DataFrame({"query_id": q["query_id"].iloc[:0], "key": q["key"].iloc[:0], "rank": np.zeros(0, np.int32),
                                 "ref_id": r["ref_id"].iloc[:0], "ref_label": r["ref_label"].iloc[:0].astype(object),
                                 "similarity": np.zeros(0)})
        q = q.drop_duplicates(["query_id", "key"])
        r = r.sort_values("ref_id", kind="stable").reset_index(drop=True)
        at, sim = tile_topk(unit_rows(q["vec"].to_numpy()), unit_rows(r["vec"].to_numpy()), k)
        row = np.repeat(np.arange(len(q)), at.shape[1])
        return pd.DataFrame({
            "query_id": q["query_id"].to_numpy()[row], "key": q["key"].to_numpy()[row],
            "rank": np.tile(np.arange(1, at.shape[1] + 1, dtype=np.int32), len(q)),
            "ref_id": r["ref_id"].to_numpy()[at.ravel()],
            "ref_label": r["ref_label"].to_numpy()[at.ravel()],
            "similarity": sim.ravel(),
        })
    return run


def similarity_topk(queries: DataFrame, refs: DataFrame, k: int = S.KNN_K,
                    query_id: str = "query_id", query_vec: str = "vec",
                    ref_id: str = "ref_id", ref_vec: str = "vec", ref_label: str = "label",
                    query_block: int = 4096, ref_block: int = 16384) -> DataFrame:
    """For every query row, its ``k`` most cosine-similar reference rows.

    Output ``(query_id, rank, ref_id, ref_label, similarity)``; ties on similarity
    go to the smaller ``ref_id``; a zero vector has similarity 0 with everything. Rows that
    repeat an id with another vector are queries of their own, each with ``k`` rows; rows that
    repeat both are one query. (``vote`` then pools the rows of an id.)"""
    q = queries.select(F.col(query_id).alias("query_id"), F.xxhash64(query_vec).alias("key"), F.col(query_vec).alias("vec"))
    r = refs.select(F.col(ref_id).alias("ref_id"), F.col(ref_vec).alias("vec"),
                    F.col(ref_label).alias("ref_label"))
    out_schema = _out_schema(q.schema["query_id"].dataType, r.schema["ref_id"].dataType, r.schema["ref_label"].dataType)
    out_schema = T.StructType([out_schema[0], T.StructField("key", T.LongType()), *out_schema[1:]])
    cores = q.sparkSession.sparkContext.defaultParallelism
    nq_blocks = max(cores, math.ceil(q.count() / query_block))
    nr_blocks = max(1, math.ceil(r.count() / ref_block))
    qx = (q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq_blocks)).cast("int"))
           .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr_blocks - 1)))))
    rx = (r.withColumn("rb", F.pmod(F.xxhash64("ref_id"), F.lit(nr_blocks)).cast("int"))
           .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq_blocks - 1)))))
    local = (qx.groupBy("qb", "rb").cogroup(rx.groupBy("qb", "rb")).applyInPandas(_local_topk(k), out_schema))
    w = Window.partitionBy("query_id", "key").orderBy(F.col("similarity").desc(), F.col("ref_id"))
    return (local.drop("rank").withColumn("rank", F.row_number().over(w))
                 .where(F.col("rank") <= k).select(*TOPK_FIELDS))


def vote(topk: DataFrame, threshold: float = S.KNN_THRESHOLD) -> DataFrame:
    """Per query, label with the largest similarity *sum* wins (tie -> the label
    of the nearer neighbour); confidence = mean similarity of the winner's
    neighbours; accepted when confidence >= threshold.

    Output ``(query_id, predicted, score, votes, confidence, accepted, method)``."""
    per_label = topk.groupBy("query_id", "ref_label").agg(
        F.sum("similarity").alias("score"), F.count(F.lit(1)).alias("votes"),
        F.min("rank").alias("best_rank"))
    win = per_label.groupBy("query_id").agg(F.max_by(
        F.struct("ref_label", "score", "votes"),
        F.struct(F.col("score"), (-F.col("best_rank")).alias("nb"))).alias("w"))
    conf = F.col("w.score") / F.col("w.votes")
    return win.select(
        "query_id", F.col("w.ref_label").alias("predicted"), F.col("w.score").alias("score"),
        F.col("w.votes").alias("votes"), conf.alias("confidence"),
        (conf >= threshold).alias("accepted"),
        F.when(conf >= threshold, "auto").otherwise("manual_review").alias("method"))


def nearest(topk: DataFrame, threshold: float = S.KNN_THRESHOLD) -> DataFrame:
    """The 1-NN variant -- label of the nearest reference written
    unconditionally; the threshold only decides whether it counts as classified."""
    first = topk.where(F.col("rank") == 1)
    return first.select("query_id", F.col("ref_label").alias("predicted"),
                        F.col("similarity").alias("confidence"),
                        (F.col("similarity") >= threshold).alias("accepted"))


def run_counts(votes: DataFrame) -> DataFrame:
    """Classified / not classified counts of a run."""
    return votes.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
