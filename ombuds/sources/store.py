"""Complaints stored by month: a batch replaces only the months that it holds, and a report over a
period opens only the folders of that period.

The layout has one integer column more, ``month`` (``yyyymm`` in the session's time zone), which
is a folder and not in the files. Rows without a date lie in a folder of their own: reads of the
whole table have them, reads of a period do not (as ``date_filter`` drops them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..operators.kpi import _to_datetime, date_filter

MONTH = "month"


def write_months(df: DataFrame, path: str, ts: str = S.REGISTERED_AT) -> None:
    """Store ``df`` by month. A month that the batch holds is replaced as a whole, other months stay,
    so a repeated batch changes nothing; an empty batch writes nothing.

    ``rebalance`` gathers each month in few files: adaptive execution splits the large months and
    joins the small ones, so one month may hold most rows. A column named ``month`` of the batch is
    an error, as it would be lost."""
    if MONTH in df.columns:
        raise ValueError(f"the batch has a column {MONTH!r} of its own")
    month = (F.year(ts) * 100 + F.month(ts)).cast("int")
    (df.withColumn(MONTH, month).hint("rebalance", MONTH).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))


def read_months(spark: SparkSession, path: str, schema: T.StructType, start=None, end=None, ts: str = S.REGISTERED_AT,
                end_inclusive: str = "midnight") -> DataFrame:
    """The stored rows, of ``start`` to ``end`` as ``date_filter`` has them if both are given.

    The period's months are partition filters, its days reach the scan of the files that are left."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.IntegerType())])).parquet(path)
    if start is not None and end is not None:
        a, b = _to_datetime(start), _to_datetime(end)
        df = df.where(F.col(MONTH).between(a.year * 100 + a.month, b.year * 100 + b.month))
        df = date_filter(df, start, end, ts, end_inclusive)
    return df.drop(MONTH)
