"""S4 multi-source ingest: map names, coerce dates, concatenate in source order,
keep the first record per key (W7), and the ingest statistics (A27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions import temporal as T
from ..operators.dedupe import keep_first
from .columns import map_columns


def harmonise(df: DataFrame, source_ord: int, source_name: str | None = None,
              parse_dates: bool = True) -> DataFrame:
    """P1 + P3 for one source, tagged with its order and name."""
    out = map_columns(df)
    if parse_dates:
        types = dict(out.dtypes)
        for c in S.DATE_COLUMNS:
            if c in types:  # text dates are parsed; typed ones pass through
                out = out.withColumn(c, T.parse_timestamp(c) if types[c] == "string"
                                     else F.col(c).cast("timestamp_ntz"))
    return out.withColumns({"source_ord": F.lit(source_ord),
                            "source_name": F.lit(source_name or f"source{source_ord}")})


def concat_sources(sources: list[DataFrame], names: list[str] | None = None,
                   parse_dates: bool = True) -> DataFrame:
    """Union by name, missing optional columns become null."""
    out = None
    for i, src in enumerate(sources):
        h = harmonise(src, i, names[i] if names else None, parse_dates)
        out = h if out is None else out.unionByName(h, allowMissingColumns=True)
    return out


def ingest(sources: list[DataFrame], names: list[str] | None = None, key: str = S.KEY,
           order: list[str] | None = None, parse_dates: bool = True) -> DataFrame:
    """Concatenate, then keep the first row per key in (source order, row order).

    The row order is ``row_id``, a number: files are read with their rows' places, and a
    source without it takes the order of its scan. Ids that are no numbers sort last; equal
    ones go by file, then by place in the scan."""
    if not order:
        sources = [s if "row_id" in s.columns else s.withColumn("row_id", F.monotonically_increasing_id())
                   for s in sources]
        text = [s for s in sources if s.schema["row_id"].dataType.typeName() == "string"]
        sources = [s.withColumn("row_id", F.expr("try_cast(row_id AS decimal(33,0))")) if s in text else s
                   for s in sources] if text else sources
    allrows = concat_sources(sources, names, parse_dates)
    if key not in allrows.columns:
        return allrows
    file = ["_file"] if "_file" in allrows.columns else []
    return keep_first(allrows, key, order or ["source_ord", "row_id", *file])


def ingest_stats(sources: list[DataFrame], names: list[str] | None = None,
                 key: str = S.KEY) -> DataFrame:
    """A27 in long form ``(metric, source_name, n)``: rows per source, total before,
    duplicates removed, total after -- from one aggregation keyed by the record key
    (partial aggregation first, so a hot key costs one row per map task)."""
    allrows = concat_sources(sources, names, parse_dates=False)
    k = len(sources)
    per_key = allrows.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"),
        *[F.count_if(F.col("source_ord") == i).alias(f"s{i}") for i in range(k)])
    tot = per_key.agg(F.sum("copies").alias("before"), F.count(F.lit(1)).alias("after"),
                      *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    labels = names or [f"source{i}" for i in range(k)]
    parts = [f"'rows', '{labels[i]}', s{i}" for i in range(k)]
    parts += ["'total_before', NULL, before", "'duplicates_removed', NULL, before - after",
              "'total_after', NULL, after"]
    expr = f"stack({len(parts)}, {', '.join(parts)}) AS (metric, source_name, n)"
    return tot.selectExpr(expr).select("metric", F.col("source_name").cast("string"),
                                       F.col("n").cast("bigint"))
