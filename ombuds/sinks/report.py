"""Report sinks (K1-K4).

K4 (the reference's multi-sheet workbook) becomes five datasets written side by
side; the input is persisted once because five aggregations read it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..operators import kpi, ranking, temporal
from ..sources.csv import write_csv


def report_sections(df: DataFrame) -> dict[str, DataFrame]:
    """K4 sections: full data, category summary %, branch summary %, monthly counts
    (with a NULL month row for missing dates) and the statistics row."""
    out = {"data": df}
    if S.CATEGORY in df.columns:
        out["category_summary"] = ranking.ranking(df, S.CATEGORY)
    if S.BRANCH in df.columns:
        out["branch_summary"] = ranking.ranking(df, S.BRANCH)
    if S.REGISTERED_AT in df.columns:
        out["monthly"] = temporal.monthly_counts(df, keep_null=True).select("month_key", "n")
        out["statistics"] = kpi.kpi_row(df)
    return out


def export_report(df: DataFrame, path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every section under ``path/<section>``; returns section -> path."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    written = {}
    try:
        for name, part in report_sections(cached).items():
            target = f"{path.rstrip('/')}/{name}"
            if fmt == "csv":
                write_csv(part, target, sep=",", encoding="UTF-8")
            elif fmt == "json":
                export_json(part, target)
            else:
                part.write.mode("overwrite").parquet(target)
            written[name] = target
    finally:
        cached.unpersist()
    return written


def export_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """K1 (utf-8, no BOM: Spark writes none) / K2 (``sep=';'``, ``encoding='ISO-8859-1'``)."""
    write_csv(df, path, sep=sep, encoding=encoding)


def export_json(df: DataFrame, path: str) -> None:
    """K3: JSON Lines, timestamps as ISO-8601 text."""
    ts_cols = [c for c, t in df.dtypes if t.startswith("timestamp")]
    out = df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in ts_cols}) if ts_cols else df
    out.write.mode("overwrite").json(path)
