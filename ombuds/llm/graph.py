"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, few, written

#: Edges of a written file, about.
EDGES = 500_000


def _fingerprint(edges: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root: the component's least node.

    Each round links every node to the least of its neighbours (large star), then every node's
    smaller neighbours to their least (small star), until nothing changes. Neighbours are never
    gathered: a hot node is only a minimum, reduced in each task, and one side of a join.
    Rounds are written to the shared folder.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(spark, few(e, 1), "edges")
    last = _fingerprint(e)
    parts = max(1, -(-last[0] // EDGES))
    while last[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))).distinct()
        old, e = e, written(spark, small.coalesce(parts), "edges")
        discard(old)
        now = _fingerprint(e)
        if now == last:
            break
        last = now
    # converged: every edge leads from a node to its component's least node
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
