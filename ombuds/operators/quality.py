"""Data-quality checks as a DataFrame of issues (A8-A11) and the training-data
profile (A24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..functions import text as X
from ..session import written

ISSUE_SCHEMA = T.StructType([
    T.StructField("severity", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("column", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("sample", T.StringType())])


def quality_issues(df: DataFrame, required: list[str] | None = None, key: str = S.KEY,
                   date_col: str = S.REGISTERED_AT, sample_size: int = 10,
                   raw_dates: str | None = None) -> DataFrame:
    """Issues ``(severity, rule, column, n, sample)``; valid = no 'error' rows.

    * missing required columns (early stop, like the reference);
    * duplicate keys: number of keys seen more than once, sample = first 10 keys
      in key order (a top-10, never a full collect);
    * null count per required column, null dates;
    * with ``raw_dates`` (the column of the unparsed text): dates that could not be parsed.

    The input is read once: one keyed aggregation carries copies and null counts, so a hot
    key is one row per map task."""
    spark: SparkSession = df.sparkSession
    required = required or S.REQUIRED_COLUMNS
    missing = [c for c in required if c not in df.columns]
    if missing:
        return spark.createDataFrame(
            [("error", "missing_columns", None, len(missing), ", ".join(missing))], ISSUE_SCHEMA)

    counts = {c: F.count_if(F.col(c).isNull()) for c in required if c != key}
    counts["_null_dates"] = F.count_if(F.col(date_col).isNull())
    if raw_dates is not None:
        counts["_unparseable"] = F.count_if(F.col(raw_dates).isNotNull() & F.col(date_col).isNull())
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"), *(v.alias(n) for n, v in counts.items()))
    per_key = written(spark, per_key, "quality-keys")  # one row per key; read by the two branches below
    a = per_key.agg(F.count_if(F.col("_c") > 1).alias("_dups"),
                    F.sum(F.when(F.col(key).isNull(), F.col("_c")).otherwise(0)).alias(key),
                    *(F.sum(n).alias(n) for n in counts))
    sample = (per_key.where(F.col("_c") > 1).select(key).orderBy(F.col(key).asc_nulls_first()).limit(sample_size)
              .agg(F.array_join(F.collect_list(F.col(key)), ", ").alias("s"))).select("s").scalar()
    rows = [("error", "duplicate_key", key, "_dups")] + [("error", "null_values", c, c) for c in required]
    rows.append(("warning", "null_dates", date_col, "_null_dates"))
    if raw_dates is not None:
        rows.append(("warning", "unparseable_dates", date_col, "_unparseable"))
    parts = ", ".join(f"'{sev}', '{rule}', '{c}', CAST(`{v}` AS BIGINT)" for sev, rule, c, v in rows)
    issues = a.selectExpr(f"stack({len(rows)}, {parts}) AS (severity, rule, column, n)").where(F.col("n") > 0)
    return issues.select("*", F.when(F.col("rule") == "duplicate_key", sample).alias("sample"))


def is_valid(issues: DataFrame) -> bool:
    return issues.where(F.col("severity") == "error").limit(1).count() == 0


def training_profile(df: DataFrame, label: str = S.CATEGORY,
                     text_columns: list[str] | None = None) -> DataFrame:
    """Label validity shares and text-column coverage, long form
    ``(metric, n, pct)``. 'outros' here is upper-cased equality without strip,
    'blank' is null only (as the profiling script counts)."""
    text_columns = [c for c in (text_columns or ["DS_OBSERVACAO", "DS_TRATATIVA", "DS_RETORNO", "DS_MOTIVO"])
                    if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col(label).isNull()).alias("blank"),
            F.count_if(F.coalesce(F.upper(F.col(label)).isin(*S.GENERIC_CATEGORIES), F.lit(False))).alias("outros"),
            F.countDistinct(label).alias("distinct_labels")]
    aggs += [F.count(F.col(c)).alias(f"cov_{c}") for c in text_columns]
    a = df.agg(*aggs).withColumn("valid", F.col("total") - F.col("blank") - F.col("outros"))
    metrics = ["valid", "blank", "outros", "distinct_labels"] + [f"cov_{c}" for c in text_columns]
    parts = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return a.selectExpr(f"stack({len(metrics)}, {parts}) AS (metric, n)", "total").select(
        "metric", F.col("n").cast("bigint").alias("n"),
        F.when(F.col("metric") == "distinct_labels", F.lit(None).cast("double"))
         .otherwise(F.round(F.col("n") * 100.0 / F.col("total"), 2)).alias("pct"))


def needs_flags(df: DataFrame) -> DataFrame:
    """P4-P6 as columns next to the labels (for inspection and tests)."""
    return df.select(S.KEY, S.CATEGORY, S.SUBCATEGORY,
                     X.needs_category(S.CATEGORY).alias("needs_category"),
                     X.needs_subcategory(S.SUBCATEGORY).alias("needs_subcategory"),
                     X.has_outro(S.SUBCATEGORY).alias("has_outro"))
