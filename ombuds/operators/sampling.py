"""Seeded, reproducible sampling (W8, W10, W11) and sample coverage.

Random draws are replaced by a deterministic order: ``md5(id || ':' || seed)``.
Selecting "the first n rows of each label in that order" is done without
sorting a whole label in one task (one label may hold a third of all rows):

1. rows are counted per (label, hash bucket) -- the bucket is the first four hex
   digits of the hash, so 65,536 ordered buckets per label;
2. a running sum over those counts (a window over the *aggregate*) finds the single
   boundary bucket per label and how many rows are still wanted from it;
3. only the hashes of a boundary bucket are ranked, about 1/65,536 of a label, and
   every row is compared with the last hash that is in.

Ids must be unique: rows of equal ids have equal hashes and are drawn together.

The result equals ``row_number() OVER (PARTITION BY label ORDER BY hash) <= n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S


def order_hash(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def flag_first_n_per_group(df: DataFrame, group: str, n_per_group,
                           id_col: str, seed: int = 42, flag: str = "selected") -> DataFrame:
    """All rows of ``df`` plus a boolean ``flag``: hash rank within ``group`` <= n.

    ``n_per_group`` is an int or a function ``(group_count, total_count) -> Column``
    giving n from the group's row count and the table's row count.

    Plan: one aggregation per (group, bucket); running sums over that aggregate leave one
    row per group: its boundary bucket and the rows still wanted from it. Rows of lower buckets
    are in, of higher ones out. Only the hashes of the boundary buckets are ranked, about
    1/65,536 of a group, to find the last hash that is in; rows are then compared with it.
    The tables of one row per group are broadcast by hint: left to AQE they are joined by a shuffle, since
    most of their partitions are empty, and that sends all rows of a label, texts and all, to one
    task. So the labels, not the rows, must fit a broadcast. Null groups use their own key."""
    x = (df.withColumn("_h", order_hash(id_col, seed))
           .withColumn("_b", F.substring("_h", 1, 4))
           .withColumn("_g", F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))))
    last = _last_hash(x, n_per_group)
    return (x.join(F.broadcast(last), "_g").withColumn(flag, F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False)))
             .select(*df.columns, flag))


def _last_hash(x: DataFrame, n_per_group) -> DataFrame:
    """(_g, _last): the hash of the n-th row of each group (null if none is wanted)."""
    counts = x.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    group_count = F.sum("_cnt").over(Window.partitionBy("_g"))
    if callable(n_per_group):
        total = counts.select(F.sum("_cnt")).scalar()  # scalar subquery over the aggregate
        n = n_per_group(group_count, total)
    else:
        n = F.lit(int(n_per_group))
    cum = counts.select("_g", "_b", "_cnt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_before"),
                        F.least(n.cast("bigint"), group_count).alias("_n"))
    edge = cum.where((F.col("_before") < F.col("_n")) & (F.col("_n") <= F.col("_before") + F.col("_cnt")))
    edge = edge.select("_g", "_b", (F.col("_n") - F.col("_before")).alias("_want"))
    inner = x.select("_g", "_b", "_h").join(F.broadcast(edge), ["_g", "_b"])
    rank = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h"))
    cut = inner.withColumn("_r", rank).where(F.col("_r") == F.col("_want")).select("_g", F.col("_h").alias("_last"))
    return counts.select("_g").distinct().join(cut, "_g", "left")


def first_n_per_group(df: DataFrame, group: str, n_per_group,
                      id_col: str, seed: int = 42) -> DataFrame:
    """Rows whose hash rank within ``group`` is <= n (see module doc)."""
    return (flag_first_n_per_group(df, group, n_per_group, id_col, seed, "_sel")
            .where(F.col("_sel")).drop("_sel"))


def stratified_sample_a(df: DataFrame, label: str, id_col: str, total: int = 5000,
                        min_per_label: int = 10, seed: int = 42) -> DataFrame:
    """W8 form A: per label n = min(count, max(floor(count * total / N), 10)) when the
    table has more than ``total`` rows; otherwise everything."""
    def n(c, n_all):
        return F.when(n_all > total, F.least(c, F.greatest(F.floor(c * total / n_all),
                                                           F.lit(min_per_label)))).otherwise(c)
    return first_n_per_group(df.where(F.col(label).isNotNull()), label, n, id_col, seed)


def stratified_sample_b(df: DataFrame, label: str, id_col: str, total: int = 5000,
                        seed: int = 42) -> DataFrame:
    """W8 form B: per label n = min(count, max(1, floor(total * count / N))) when N > total."""
    def n(c, n_all):
        return F.when(n_all > total, F.least(c, F.greatest(F.lit(1), F.floor(c * total / n_all)))).otherwise(c)
    return first_n_per_group(df.where(F.col(label).isNotNull()), label, n, id_col, seed)


def fixed_per_label(df: DataFrame, label: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """W8 with a fixed n per label (min(n, count))."""
    return first_n_per_group(df.where(F.col(label).isNotNull()), label, n, id_col, seed)


def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: per label the first ceil(fraction * count) rows in hash
    order are the test part, the rest the training part."""
    return flag_first_n_per_group(df, label, lambda c, _n: F.ceil(c * test_fraction),
                                  id_col, seed, "is_test")


def simple_sample(df: DataFrame, id_col: str, n: int = 200, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in hash order (a top-n: per-partition top-n, then merge)."""
    return df.withColumn("_h", order_hash(id_col, seed)).orderBy("_h").limit(n).drop("_h")


def sample_coverage(original: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """Per label, rows in the original, rows in the sample, and the sampled %."""
    o = original.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("original"))
    s = sample.groupBy(label).agg(F.count(F.lit(1)).alias("sampled"))
    return (o.join(s, label, "left").select(
        F.col(label).alias("label"), "original",
        F.coalesce("sampled", F.lit(0)).alias("sampled"),
        F.round(F.coalesce("sampled", F.lit(0)) * 100.0 / F.col("original"), 2).alias("sampled_pct")))


def valid_training_rows(df: DataFrame, text_col: str = "texto_referencia",
                        label: str = S.CATEGORY, sub: bool = False) -> DataFrame:
    """label present (P4/P5 false) and, for categories, text of >= 10 characters."""
    from ..functions import text as X
    if sub:
        return df.where(~X.needs_subcategory(label))
    return df.where(~X.needs_category(label) & X.enough_text(text_col))
