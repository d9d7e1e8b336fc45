"""Fill missing categories / sub-categories by neighbour voting.

Composition: needs-flag -> composite text -> encoder -> broadcast reference set -> vote, all in
one pass over the rows (``label_rows``). Only rows that need a label are encoded. Reference
sets are stored and bounded (``reference``). ``write_back`` joins predictions that come as a
table of their own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schema as S
from ..functions import text as X
from ..session import shared_dir
from . import knn, reference
from .reference import ReferenceSet


def write_back(table: DataFrame, votes: DataFrame, key: str, label: str, needs: Column,
               min_confidence_col: str = "accepted") -> DataFrame:
    """Rows that need a label take the accepted prediction; everything else keeps
    its value. Rows that need nothing are not shuffled: only the ``needs`` part is
    joined with the predictions, then the two parts are unioned.

    Adds ``label_confidence``, ``label_method`` and ``needs_review``."""
    flagged = table.withColumn("_needs", needs)
    keep = (flagged.where(~F.col("_needs"))
                   .withColumns({"label_confidence": F.lit(None).cast("double"),
                                 "label_method": F.lit(None).cast("string"),
                                 "needs_review": F.lit(False)}))
    p = votes.select(F.col(key).alias("_k"), F.col("predicted").alias("_pred"),
                     F.col("confidence").alias("_conf"), F.col(min_confidence_col).alias("_ok"))
    todo = flagged.where(F.col("_needs"))
    joined = todo.join(p, todo[key].eqNullSafe(p["_k"]), "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    label_type = dict(table.dtypes)[label]
    filled = joined.withColumns({
        label: F.when(ok, F.col("_pred").cast(label_type)).otherwise(F.col(label)),
        "label_confidence": F.col("_conf"),
        "label_method": F.when(ok, "auto").otherwise("manual_review"),
        "needs_review": ~ok}).drop("_k", "_pred", "_conf", "_ok")
    return keep.unionByName(filled).drop("_needs")


def label_rows(df: DataFrame, need: Column, text: Column, reference: ReferenceSet, k: int = S.KNN_K,
               threshold: float = S.KNN_THRESHOLD, n_snippets: int = 0) -> DataFrame:
    """``df`` with ``_vote``, a struct ``(predicted, confidence, accepted, snippets)``, on the rows that ``need`` it.

    One pass over the rows where they are: texts of the rows in need are encoded, multiplied
    by the broadcast reference matrix, and voted row by row (the rule of ``knn.vote``).
    Nothing is joined, so null or repeated keys are no special case."""
    ids, labels, matrix = reference.arrays()
    near = reference.snippets() if n_snippets else []
    shared = df.sparkSession.sparkContext.broadcast((np.array(labels.to_pylist(), object), matrix, near))
    vote = T.StructType.fromDDL("predicted string, confidence double, accepted boolean, snippets array<string>")
    full = T.StructType([*df.schema, T.StructField("_vote", vote)])
    kind = pa.struct([("predicted", pa.string()), ("confidence", pa.float64()), ("accepted", pa.bool_()),
                      ("snippets", pa.list_(pa.string()))])
    coded = reference.encoder.encode(df.withColumn("_query", F.when(need, text)), "_query", "_vec").drop("_query")

    def run(batches):
        labels, matrix, near = shared.value
        for b in batches:
            got = [None] * b.num_rows
            vec = b.column(b.num_columns - 1)
            rows = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
            if len(rows) and len(labels):
                q = knn.unit_rows(vec.take(pa.array(rows)).to_numpy(zero_copy_only=False))
                at, sim = knn.tile_topk(q, matrix, k)
                for i, a, s in zip(rows.tolist(), at, sim):
                    score: dict = {}
                    for name, v in zip(labels[a], s.tolist()):  # nearest first, so ties keep the nearer
                        score.setdefault(name, []).append(v)
                    best = max(score, key=lambda name: sum(score[name]))
                    conf = sum(score[best]) / len(score[best])
                    got[i] = {"predicted": best, "confidence": conf, "accepted": conf >= threshold,
                              "snippets": [near[j] for j in a[:n_snippets]] if n_snippets else []}
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, kind)], names=full.names)

    return coded.select(*df.columns, "_vec").mapInArrow(run, full)


def fill_labels(df: DataFrame, reference: ReferenceSet, label: str = S.CATEGORY, sub: bool = False,
                k: int = S.KNN_K, threshold: float = S.KNN_THRESHOLD, max_chars: int | None = None) -> DataFrame:
    """M3 (category, ``sub=False``) / M4 (sub-category, ``sub=True``) with J3 in place.

    Rows that need the label (no length check, as the reference) take the accepted prediction.
    Adds ``label_confidence``, ``label_method`` and ``needs_review``."""
    need = X.needs_subcategory(label) if sub else X.needs_category(label)
    done = label_rows(df.withColumn("_need", need), F.col("_need"), X.composite_text(df.columns, max_chars=max_chars),
                      reference, k, threshold)
    ok = F.coalesce(F.col("_vote.accepted"), F.lit(False))
    return done.withColumns({
        label: F.when(ok, F.col("_vote.predicted").cast(df.schema[label].dataType)).otherwise(F.col(label)),
        "label_confidence": F.col("_vote.confidence"),
        "label_method": F.when(F.col("_need"), F.when(ok, "auto").otherwise("manual_review")),
        "needs_review": F.col("_need") & ~ok}).drop("_vote", "_need")


def autolabel(df: DataFrame, path: str | None = None, encoder=None, threshold: float = S.KNN_THRESHOLD,
              k: int = S.KNN_K, max_rows: int = reference.MAX_ROWS, key: str = S.KEY) -> DataFrame:
    """M9: categories first, then sub-categories on the result. The category text
    contains SUB_ASSUNTO *before* it is refilled, as in the reference.

    Both reference sets are built from ``df`` (no text part depends on the category) and stored
    below ``path``, by default in the shared folder."""
    path = path or shared_dir(df.sparkSession, f"references-{uuid.uuid4().hex}")
    out = df
    for name, column, sub in (("category", S.CATEGORY, False), ("subcategory", S.SUBCATEGORY, True)):
        if column in df.columns:
            ref = reference.build_reference_set(df, column, f"{path}/{name}", encoder, key, sub, max_rows)
            out = fill_labels(out, ref, column, sub, k, threshold).withColumnsRenamed(
                {"label_confidence": f"{name}_confidence", "label_method": f"{name}_method",
                 "needs_review": f"{name}_needs_review"})
    return out


def classify_probes(probes: DataFrame, ref: ReferenceSet, text_col: str, probe_id: str, k: int = S.KNN_K,
                    threshold: float = S.KNN_THRESHOLD, min_length: int = S.MIN_TEXT_LENGTH) -> DataFrame:
    """M5: probe texts -> (categoria, confianca, metodo, top_similares).

    Probes shorter than ``min_length`` (after strip) go to manual review with confidence 0
    and no snippets; the others are voted, with snippets (P14) of the nearest texts."""
    few = probes.select(F.col(probe_id), F.col(text_col).alias("_text"))
    done = label_rows(few, X.enough_text("_text", min_length), F.col("_text"), ref, k, threshold, S.SNIPPET_COUNT)
    ok = F.coalesce(F.col("_vote.accepted"), F.lit(False))
    return done.select(probe_id, F.when(ok, F.col("_vote.predicted")).alias("categoria"),
                       F.coalesce(F.col("_vote.confidence"), F.lit(0.0)).alias("confianca"),
                       F.when(ok, "auto").otherwise("manual_review").alias("metodo"),
                       F.coalesce(F.col("_vote.snippets"), F.array().cast("array<string>")).alias("top_similares"))
