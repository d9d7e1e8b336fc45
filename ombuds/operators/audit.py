"""Audit tables: append-only upload / query logs (K6, K7) and their reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

UPLOAD_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("num_records", T.LongType()),
    T.StructField("user", T.StringType()), T.StructField("metadata", T.StringType()),
    T.StructField("uploaded_at", T.TimestampNTZType())])
QUERY_SCHEMA = T.StructType([
    T.StructField("query_text", T.StringType()), T.StructField("query_type", T.StringType()),
    T.StructField("user", T.StringType()), T.StructField("response_time_ms", T.DoubleType()),
    T.StructField("executed_at", T.TimestampNTZType())])


def log_upload(spark: SparkSession, path: str, filename: str, num_records: int,
               user: str = "system", metadata: str | None = None,
               at: dt.datetime | None = None) -> None:
    """K6: append one row to the upload audit table (parquet, append mode)."""
    row = [(filename, int(num_records), user, metadata, at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))]
    spark.createDataFrame(row, UPLOAD_SCHEMA).write.mode("append").parquet(path)


def log_query(spark: SparkSession, path: str, query_text: str, query_type: str,
              response_time_ms: float, user: str = "system", at: dt.datetime | None = None) -> None:
    """K7: append one row to the query audit table."""
    row = [(query_text, query_type, user, float(response_time_ms),
            at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))]
    spark.createDataFrame(row, QUERY_SCHEMA).write.mode("append").parquet(path)


def write_logged(df: DataFrame, path: str, log_path: str, filename: str, user: str = "system",
                 mode: str = "append", at: dt.datetime | None = None) -> int:
    """Write ``df`` as Parquet and log the upload (K6). The number of rows is observed by the write
    itself: there is no second scan. Returns it."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    log_upload(df.sparkSession, log_path, filename, seen.get["n"], user, at=at)
    return seen.get["n"]


def _append(rows: DataFrame, path: str, schema: T.StructType) -> None:
    names = set(rows.columns)
    rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in names
                  else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(path)


def append_uploads(uploads: DataFrame, path: str) -> None:
    """K6 for many uploads at once: columns of ``UPLOAD_SCHEMA``, missing ones null."""
    _append(uploads, path, UPLOAD_SCHEMA)


def append_queries(queries: DataFrame, path: str) -> None:
    """K7 for many queries at once: columns of ``QUERY_SCHEMA``, missing ones null."""
    _append(queries, path, QUERY_SCHEMA)


def _window(audit: DataFrame, hours: int, as_of) -> DataFrame:
    ref = as_of if as_of is not None else audit.select(F.max("executed_at")).scalar()
    since = ref - F.expr(f"INTERVAL {int(hours)} HOURS") if not isinstance(ref, dt.datetime) \
        else F.lit(ref - dt.timedelta(hours=hours))
    return audit.where(F.col("executed_at") > since)


def query_type_stats(audit: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """A26 per type: queries and mean response time in the last ``hours`` before
    ``as_of`` (default: the latest entry, as a scalar subquery in the plan)."""
    return (_window(audit, hours, as_of).groupBy("query_type")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("response_time_ms").alias("avg_response_time_ms")))


def query_stats(audit: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """A26 totals: total queries; unweighted mean of the per-type means where a
    null or zero mean adds 0 but still counts as a type; number of types."""
    per = query_type_stats(audit, hours, as_of)
    m = F.col("avg_response_time_ms")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_queries"),
        F.coalesce(F.sum(F.when(m.isNotNull() & (m != 0), m).otherwise(F.lit(0.0))) / F.count(F.lit(1)),
                   F.lit(0.0)).alias("avg_response_time_ms"),
        F.count(F.lit(1)).alias("n_types"))


def upload_history(uploads: DataFrame, limit: int = 10) -> DataFrame:
    """T5: the latest ``limit`` uploads (a top-k)."""
    return (uploads.orderBy(F.col("uploaded_at").desc(), F.col("filename"))
                   .limit(limit).select("filename", "num_records", "user", "uploaded_at"))
