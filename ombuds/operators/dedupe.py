"""Keep-first de-duplication and distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Exactly one row per ``key`` -- the row that sorts first by ``order``.

    A null order sorts behind all others; rows of equal (or no) order go by their place in the
    scan, so no key is lost and none is kept twice. The rank filter becomes a group limit in each
    task before the shuffle (asserted in a test), so a key holding a third of all rows is one row
    per map task. Null keys form one group and keep one row, like the reference."""
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order], "_place")
    return placed.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).select(*df.columns)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of one column."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()
