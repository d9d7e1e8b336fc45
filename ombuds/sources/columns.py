"""Harmonise column names to the canonical schema.

Works on ``df.columns`` only (metadata), so it runs on the driver without touching
data. The score is the token-sort ratio: tokens sorted and re-joined, then
``100 * 2 * LCS / (len_a + len_b)`` (indel similarity).

Assignment is one-to-one (a deliberate divergence from an independent best match
per target, which can rename one column twice or steal a column): identical names
are reserved first, then exact alias hits, then the remaining pairs by descending
score; every source column and every target is used at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from .. import schema as S


def normalise_name(name: str) -> str:
    return name.strip().lower().replace("_", " ")


def _lcs(a: str, b: str) -> int:
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def token_sort_ratio(a: str, b: str) -> float:
    sa = " ".join(sorted(a.split()))
    sb = " ".join(sorted(b.split()))
    if not sa and not sb:
        return 100.0
    return 100.0 * 2 * _lcs(sa, sb) / (len(sa) + len(sb))


def plan_mapping(columns: list[str], aliases: dict[str, list[str]] | None = None,
                 threshold: float = S.COLUMN_MATCH_THRESHOLD) -> list[tuple[str, str | None, float]]:
    """Return ``(original, target or None, score)`` for every column."""
    aliases = aliases or S.COLUMN_ALIASES
    targets = list(aliases)
    variants = {t: [normalise_name(t)] + [normalise_name(v) for v in aliases[t]] for t in targets}
    chosen: dict[str, tuple[str, float]] = {}
    used_targets: set[str] = set()

    for c in columns:  # identical names are reserved
        if c in aliases and c not in used_targets:
            chosen[c] = (c, 100.0)
            used_targets.add(c)
    for c in columns:  # exact alias hits
        if c in chosen:
            continue
        n = normalise_name(c)
        for t in targets:
            if t not in used_targets and n in variants[t]:
                chosen[c] = (t, 100.0)
                used_targets.add(t)
                break
    pairs = []
    for ci, c in enumerate(columns):
        if c in chosen:
            continue
        n = normalise_name(c)
        for ti, t in enumerate(targets):
            if t in used_targets:
                continue
            score = max(token_sort_ratio(n, v) for v in variants[t])
            if score >= threshold:
                pairs.append((-score, ci, ti, c, t, score))
    for _, _, _, c, t, score in sorted(pairs):
        if c not in chosen and t not in used_targets:
            chosen[c] = (t, score)
            used_targets.add(t)
    return [(c, *chosen[c]) if c in chosen else (c, None, 0.0) for c in columns]


def map_columns(df: DataFrame, aliases: dict[str, list[str]] | None = None,
                threshold: float = S.COLUMN_MATCH_THRESHOLD) -> DataFrame:
    """Rename columns to canonical names; unmapped columns are carried along."""
    renames = {c: t for c, t, _ in plan_mapping(df.columns, aliases, threshold) if t and t != c}
    return df.withColumnsRenamed(renames) if renames else df


MAPPING_REPORT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("original", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("changed", T.BooleanType())])


def mapping_report(spark: SparkSession, sources: dict[str, list[str]],
                   aliases: dict[str, list[str]] | None = None,
                   threshold: float = S.COLUMN_MATCH_THRESHOLD) -> DataFrame:
    """``(source, original, target, score, changed)`` per column of each source."""
    rows = [(src, c, t, round(float(s), 1), bool(t) and t != c)
            for src, cols in sources.items()
            for c, t, s in plan_mapping(cols, aliases, threshold)]
    return spark.createDataFrame(rows, MAPPING_REPORT_SCHEMA)
