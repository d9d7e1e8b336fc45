"""Label rankings with share of total (category, sub-category, branch, operator)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as Ty

from .. import schema as S
from ..functions import text as X

RANKING_SCHEMA = Ty.StructType([
    Ty.StructField("rank", Ty.IntegerType()), Ty.StructField("label", Ty.StringType()),
    Ty.StructField("n", Ty.LongType()), Ty.StructField("share_pct", Ty.DoubleType())])


def ranking(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Counts per non-null value, count desc then label asc (T1), with share %.

    The share window runs over the aggregate (one row per distinct value)."""
    counts = (df.where(F.col(col).isNotNull())
                .groupBy(F.col(col).alias("label"))
                .agg(F.count(F.lit(1)).alias("n")))
    order = Window.orderBy(F.col("n").desc(), F.col("label"))
    total = F.sum("n").over(Window.partitionBy())
    if top is not None:  # T4: head(n); only the top rows meet in the ranking window
        total = counts.select(F.sum("n")).scalar()
        counts = counts.orderBy(F.col("n").desc(), F.col("label")).limit(top)
    return counts.select(F.row_number().over(order).alias("rank"), "label", "n",
                         F.round(F.col("n") * 100.0 / total, 2).alias("share_pct"))


def category_ranking(df: DataFrame, drop_generic: bool = False, top: int | None = None) -> DataFrame:
    """A3 (+F2 when ``drop_generic``)."""
    src = df.where(X.keep_specific_category(S.CATEGORY)) if drop_generic else df
    return ranking(src, S.CATEGORY, top)


def subcategory_ranking(df: DataFrame, drop_generic: bool = False, top: int | None = None) -> DataFrame:
    """A4 (+F3 when ``drop_generic``)."""
    src = df.where(X.keep_specific_subcategory(S.SUBCATEGORY)) if drop_generic else df
    return ranking(src, S.SUBCATEGORY, top)


def branch_ranking(df: DataFrame, top: int | None = None) -> DataFrame:
    """A5."""
    return ranking(df, S.BRANCH, top)


def operator_ranking(df: DataFrame, top: int | None = None) -> DataFrame:
    """Only when the optional OPERADORA column exists; otherwise an empty result."""
    if S.OPERATOR not in df.columns:
        return df.sparkSession.createDataFrame([], RANKING_SCHEMA)
    return ranking(df, S.OPERATOR, top)
