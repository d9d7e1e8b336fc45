"""Counts per week / month and the period-over-period reports built on them.

Every window in this module runs over an *aggregate* (one row per period, or per
period x label), never over raw rows: the raw table is reduced by a partial +
final hash aggregation first, so a global ``orderBy`` window sees at most a few
thousand rows however large the input is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from ..functions import temporal as T


def weekly_counts(df: DataFrame, ts: str = S.REGISTERED_AT) -> DataFrame:
    """A1: complaints per Monday-started week; null dates dropped."""
    return (df.where(F.col(ts).isNotNull())
              .groupBy(T.week_start(ts).alias("week_start"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select("week_start", F.date_add("week_start", 6).alias("week_end"),
                      F.concat(F.date_format("week_start", "dd/MM"), F.lit("-"),
                               F.date_format(F.date_add("week_start", 6), "dd/MM")).alias("week_label"),
                      "n"))


def monthly_counts(df: DataFrame, ts: str = S.REGISTERED_AT, keep_null: bool = False) -> DataFrame:
    """A2: complaints per month. ``keep_null`` keeps a NULL month row (report form);
    the chart form drops null dates."""
    src = df if keep_null else df.where(F.col(ts).isNotNull())
    return (src.groupBy(T.month_start(ts).alias("month"))
               .agg(F.count(F.lit(1)).alias("n"))
               .select("month", F.date_format("month", "yyyy-MM").alias("month_key"),
                       F.date_format("month", "MMM/yyyy").alias("month_label"), "n"))


def monthly_change(df: DataFrame, ts: str = S.REGISTERED_AT) -> DataFrame:
    """Month-over-month % change, with the midpoint the chart annotates.

    ``annotated`` is false for the first month and for a zero change (suppressed)."""
    m = monthly_counts(df, ts)
    w = Window.orderBy("month")  # over <= #months rows
    prev = F.lag("n").over(w)
    out = m.select("month", "month_label", "n", prev.alias("prev_n"))
    pct = T.pct_change(F.col("n"), F.col("prev_n"))
    return out.select(
        "month", "month_label", "n", "prev_n",
        F.round(pct, 4).alias("pct_change"),
        ((F.col("n") + F.col("prev_n")) / 2.0).alias("midpoint"),
        F.coalesce(pct != 0, F.lit(False)).alias("annotated"))


def _last_two(counts: DataFrame, period: str, label: str) -> DataFrame:
    """W2/W3 core: the last two periods of a count table in one row.

    With one period only, it is compared with itself (as the reference does)."""
    top = counts.orderBy(F.col(period).desc()).limit(2)  # TakeOrderedAndProject
    agg = top.agg(
        F.min(period).alias("period_1"), F.max(period).alias("period_2"),
        F.min_by(label, period).alias("label_1"), F.max_by(label, period).alias("label_2"),
        F.min_by("n", period).alias("count_1"), F.max_by("n", period).alias("count_2"))
    pct = T.pct_change(F.col("count_2"), F.col("count_1"))
    return agg.where(F.col("period_2").isNotNull()).select(
        "period_1", "period_2", "label_1", "label_2", "count_1", "count_2",
        F.round(pct, 4).alias("pct_change"),
        (F.col("count_2") - F.col("count_1")).alias("abs_change"),
        T.trend(pct).alias("trend"))


def last_two_months(df: DataFrame, ts: str = S.REGISTERED_AT) -> DataFrame:
    """Latest vs previous month."""
    return _last_two(monthly_counts(df, ts), "month", "month_key")


def last_two_weeks(df: DataFrame, ts: str = S.REGISTERED_AT) -> DataFrame:
    """Latest vs previous week (null dates filtered first)."""
    return _last_two(weekly_counts(df, ts), "week_start", "week_label")


def top_labels_per_period(df: DataFrame, period_col, period_name: str,
                          label: str = S.CATEGORY, k: int = 5,
                          ts: str = S.REGISTERED_AT) -> DataFrame:
    """Counts per (period, label), top ``k`` per period by count desc, label asc.

    ``row_number() <= k`` partitioned by the period lets Catalyst insert a
    per-partition group limit before the shuffle-side window."""
    counts = (df.where(F.col(ts).isNotNull() & F.col(label).isNotNull())
                .groupBy(period_col.alias(period_name), F.col(label).alias("label"))
                .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(period_name).orderBy(F.col("n").desc(), F.col("label"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top5_weekly(df: DataFrame, label: str = S.CATEGORY, ts: str = S.REGISTERED_AT) -> DataFrame:
    """Top-5 categories per week."""
    return top_labels_per_period(df, T.week_start(ts), "week_start", label, 5, ts) \
        .select("week_start", "rank", "label", "n")


def top5_monthly_steps(df: DataFrame, label: str = S.CATEGORY, ts: str = S.REGISTERED_AT) -> DataFrame:
    """Top-5 per month plus the % step from the rank above."""
    top = top_labels_per_period(df, T.month_start(ts), "month", label, 5, ts)
    w = Window.partitionBy("month").orderBy("rank")
    prev = F.lag("n").over(w)
    return top.select("month", "rank", "label", "n",
                      F.round(T.pct_change(F.col("n"), prev), 4).alias("step_pct"))


def period_top5_nested(df: DataFrame, label: str = S.CATEGORY, ts: str = S.REGISTERED_AT) -> DataFrame:
    """Weekly counts with their top-5 attached as one text ('label: n; ...').

    Weekly totals are sums over the same (week, label) counts, rows without a label
    included. The per-week list holds at most 5 entries (bounded collect)."""
    counts = (df.where(F.col(ts).isNotNull())
                .groupBy(T.week_start(ts).alias("week_start"), F.col(label).alias("label"))
                .agg(F.count(F.lit(1)).alias("n")))
    week = Window.partitionBy("week_start")
    ranked = counts.select("week_start", "label", "n", F.sum("n").over(week).alias("total"),
                           F.row_number().over(week.orderBy(F.col("label").isNull(), F.col("n").desc(), "label"))
                            .alias("rank")).where(F.col("rank") <= 5)
    item = F.when(F.col("label").isNotNull(), F.struct("rank", "label", "n"))
    nested = ranked.groupBy("week_start").agg(F.first("total").alias("n"), F.array_sort(F.collect_list(item)).alias("t"))
    return nested.select(
        "week_start", F.concat(F.date_format("week_start", "dd/MM"), F.lit("-"),
                               F.date_format(F.date_add("week_start", 6), "dd/MM")).alias("week_label"), "n",
        F.when(F.size("t") > 0, F.array_join(F.transform("t", lambda x: F.concat(
            x["label"], F.lit(": "), x["n"].cast("string"))), "; ")).alias("top5"))


def peak_weeks(df: DataFrame, ts: str = S.REGISTERED_AT) -> DataFrame:
    """W9 (README-only rule): weeks whose count exceeds mean + 1 sample std."""
    w = weekly_counts(df, ts)
    stats = Window.partitionBy()  # over <= #weeks rows
    return (w.select("week_start", "week_label", "n",
                     F.avg("n").over(stats).alias("mean_n"),
                     F.stddev_samp("n").over(stats).alias("std_n"))
             .where(F.col("n") > F.col("mean_n") + F.col("std_n"))
             .select("week_start", "week_label", "n",
                     F.round("mean_n", 4).alias("mean_n"), F.round("std_n", 4).alias("std_n")))
