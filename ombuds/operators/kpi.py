"""Filters, key figures and classification counters (one pass each)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions import temporal as T
from ..functions import text as X


def date_filter(df: DataFrame, start, end, ts: str = S.REGISTERED_AT,
                end_inclusive: str = "midnight") -> DataFrame:
    """``start <= ts <= end``. With ``end_inclusive='midnight'`` (the reference's
    behaviour) the end is midnight of the end day, so later hours of that day are
    excluded; ``'day'`` keeps the whole end day. Null dates drop out. The predicate
    is a plain comparison on the column, so it reaches the parquet scan."""
    s = _as_ts(start)
    e = _as_ts(end)
    c = F.col(ts)
    if end_inclusive == "day":
        return df.where((c >= s) & (c < F.lit(_to_datetime(end) + dt.timedelta(days=1))))
    return df.where((c >= s) & (c <= e))


def _to_datetime(v) -> dt.datetime:
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return dt.datetime.fromisoformat(str(v))


def _as_ts(v):
    return F.lit(_to_datetime(v))


def membership_filter(df: DataFrame, categories: Iterable[str] | None = None,
                      branches: Iterable[str] | None = None) -> DataFrame:
    """F7 (README-only): keep rows whose category / branch is in the given sets."""
    out = df
    if categories is not None:
        out = out.where(F.col(S.CATEGORY).isin(list(categories)))
    if branches is not None:
        out = out.where(F.col(S.BRANCH).isin(list(branches)))
    return out


def kpi_row(df: DataFrame) -> DataFrame:
    """Total, distinct categories, distinct branches, period in whole days."""
    ts = F.col(S.REGISTERED_AT)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(S.CATEGORY).alias("n_categories"),
        F.countDistinct(S.BRANCH).alias("n_branches"),
        T.elapsed_days(F.max(ts), F.min(ts)).alias("period_days"))


def unclassified_counters(df: DataFrame) -> DataFrame:
    """Rows needing a category, needing a sub-category, and blank fields."""
    return df.agg(
        F.count_if(X.needs_category(S.CATEGORY)).alias("categories_unclassified"),
        F.count_if(X.needs_subcategory(S.SUBCATEGORY)).alias("subcategories_unclassified"),
        (F.count_if(X.is_blank(S.CATEGORY)) + F.count_if(X.is_blank(S.SUBCATEGORY))).alias("blank_fields"))


def classification_stats(df: DataFrame, label: str = S.CATEGORY, sub: bool = False) -> DataFrame:
    """Total rows, rows still needing a label, distinct labels."""
    need = X.needs_subcategory(label) if sub else X.needs_category(label)
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(need).alias("unclassified"),
                  F.countDistinct(label).alias("distinct_labels"))


def label_distribution(df: DataFrame, label: str = S.CATEGORY) -> DataFrame:
    """A13 distribution: ``value_counts`` (nulls ignored)."""
    return (df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
              .agg(F.count(F.lit(1)).alias("n")))
