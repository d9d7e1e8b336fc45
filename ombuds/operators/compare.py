"""Before/after reports of a relabelling.

Snapshots are aligned by key (the reference aligns by row position; Spark has no
row order, so a stable key is required).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from ..functions import text as X


def _counts(df: DataFrame, label: str, name: str) -> DataFrame:
    return (df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
              .agg(F.count(F.lit(1)).alias(name)))


def before_after(before: DataFrame, after: DataFrame, label: str = S.SUBCATEGORY) -> DataFrame:
    """A19 via J5: per label, count before (rows that were not 'outros'), count
    after, difference, growth % (null when the label is new) and ``is_new``."""
    b = _counts(before.where(~X.has_outro(label)), label, "before")
    a = _counts(after, label, "after")
    j = b.join(a, "label", "full_outer")
    bef, aft = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return j.select(
        "label", bef.alias("before"), aft.alias("after"), (aft - bef).alias("difference"),
        F.when(bef > 0, F.round((aft - bef) * 100.0 / bef, 4)).alias("growth_pct"),
        (bef == 0).alias("is_new"))


def before_after_totals(comparison: DataFrame) -> DataFrame:
    """Totals, labels that gained, the largest label after relabelling (what
    the reference prints as 'largest gain') and the label with the largest gain."""
    return comparison.agg(
        F.sum("before").alias("total_before"), F.sum("after").alias("total_after"),
        (F.sum("after") - F.sum("before")).alias("reclassified"),
        F.count_if(F.col("difference") > 0).alias("labels_gaining"),
        F.max_by("label", F.struct(F.col("after"), F.col("label"))).alias("largest_after_label"),
        F.max_by("label", F.struct(F.col("difference"), F.col("label"))).alias("largest_gain_label"),
        F.max("difference").alias("largest_gain"))


def reclassified_distribution(before: DataFrame, after: DataFrame, key: str = S.KEY,
                              label: str = S.SUBCATEGORY) -> DataFrame:
    """A21 via J4: new labels of the rows that were 'outros' before, with % of all
    such rows (rows whose new label is null count in the denominator)."""
    was = before.where(X.has_outro(label)).select(key)
    new = after.select(key, F.col(label).alias("new_label"))
    counts = was.join(new, key).groupBy("new_label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per label, the null label included
    return (counts.select(F.col("new_label").alias("label"), "n", F.round(F.col("n") * 100.0 / total, 2).alias("pct"))
                  .where(F.col("label").isNotNull()))


def remaining_outros(snapshots: dict[str, DataFrame], label: str = S.SUBCATEGORY) -> DataFrame:
    """Per snapshot, rows, rows still 'outros', rows classified."""
    out = None
    for name, df in snapshots.items():
        r = df.agg(F.count(F.lit(1)).alias("total"),
                   F.count_if(X.has_outro(label)).alias("remaining")).select(
            F.lit(name).alias("snapshot"), "total", "remaining",
            (F.col("total") - F.col("remaining")).alias("classified"))
        out = r if out is None else out.unionByName(r)
    return out


def outros_variants(df: DataFrame, label: str = S.SUBCATEGORY) -> DataFrame:
    """Spellings that contain OUTRO, with counts."""
    return (df.where(F.coalesce(F.upper(F.col(label)).contains(S.GENERIC_SUB_MARK), F.lit(False)))
              .groupBy(F.col(label).alias("variant")).agg(F.count(F.lit(1)).alias("n")))


def valid_label_counts(df: DataFrame, label: str = S.SUBCATEGORY) -> DataFrame:
    """A23, second half: labels that are present, not blank and without OUTRO, with counts
    and the number of distinct ones on each row."""
    valid = df.where(X.keep_specific_subcategory(label)).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    return valid.withColumn("distinct_labels", F.count(F.lit(1)).over(Window.partitionBy()))
