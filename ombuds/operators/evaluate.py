"""Accuracy by confidence threshold (A16), confusion pairs (A17), best threshold.

Predictions are made once; each threshold is a conditional count in a single
aggregation (no join against the threshold list), then ``stack``-ed to rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions import text as X


def _norm(c):
    return X.normalize_label(F.col(c).cast("string"))


def threshold_accuracy(pred: DataFrame, thresholds: list[float] | None = None,
                       truth: str = "truth", predicted: str = "predicted",
                       confidence: str = "confidence") -> DataFrame:
    """Per threshold: total, classified, correct, coverage %, accuracy of the
    classified %, overall accuracy %. A prediction below the threshold counts as
    unclassified; labels are compared after normalisation (P10)."""
    thresholds = thresholds or S.ACCURACY_THRESHOLDS
    hit = _norm(predicted) == _norm(truth)
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(thresholds):
        ok = F.col(confidence) >= F.lit(float(t))
        aggs += [F.count_if(ok & F.col(predicted).isNotNull()).alias(f"c{i}"),
                 F.count_if(ok & F.coalesce(hit, F.lit(False))).alias(f"k{i}")]
    a = pred.agg(*aggs)
    parts = ", ".join(f"CAST({float(t)} AS DOUBLE), c{i}, k{i}" for i, t in enumerate(thresholds))
    rows = a.selectExpr(f"stack({len(thresholds)}, {parts}) AS (threshold, classified, correct)", "total")
    cls, cor, tot = F.col("classified"), F.col("correct"), F.col("total")
    return rows.select(
        "threshold", "total", "classified", "correct",
        F.round(cls * 100.0 / tot, 4).alias("coverage_pct"),
        F.round(F.when(cls > 0, cor * 100.0 / cls).otherwise(F.lit(0.0)), 4).alias("accuracy_classified_pct"),
        F.round(cor * 100.0 / tot, 4).alias("accuracy_total_pct"))


def confusion_pairs(pred: DataFrame, threshold: float, truth: str = "truth",
                    predicted: str = "predicted", confidence: str = "confidence") -> DataFrame:
    """Misclassified (real -> predicted) pairs among accepted predictions."""
    real, p = _norm(truth), _norm(predicted)
    return (pred.where((F.col(confidence) >= threshold) & F.col(predicted).isNotNull() & (real != p))
                .groupBy(real.alias("real"), p.alias("predicted"))
                .agg(F.count(F.lit(1)).alias("n")))


def best_threshold(acc: DataFrame) -> DataFrame:
    """Highest overall accuracy; the first (lowest) threshold wins ties."""
    return acc.orderBy(F.col("accuracy_total_pct").desc(), F.col("threshold")).limit(1)
