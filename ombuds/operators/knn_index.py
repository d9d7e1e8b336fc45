"""Exact cosine top-k (J1) over a metric index, for references that grow with the data.

Unit vectors are points on a sphere, and the angle between them is a metric. A bounded number of
reference rows, the pivots, cut the references into cells by the nearest pivot; a cell is cut
into rings by the angle to its pivot, and a ring into blocks of about ``BLOCK`` rows. A query
knows its angle to every pivot, so the triangle inequality gives each ring a least angle that
any of its members can have.

Two steps: a query first visits the nearest rings that hold ``k`` references; the k-th angle found
there is a bound, and then it visits all further rings whose least angle does not exceed it.
References lie still: only queries are sent to the blocks that they visit, and a block never
meets a query that cannot use it. The result is exact; how much is skipped hangs on the data, and
``visits`` reports it.

Rows are told apart by (id, vector): rows that repeat an id with another vector are queries of
their own, rows that repeat both are one. A zero vector has similarity 0 with everything: zero
references form a ring of their own at a right angle, zero queries get the least reference ids.
Null ids are allowed; a null vector takes no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .. import schema as S
from ..session import written
from .knn import TOPK_FIELDS, tile_topk, unit_rows

#: Pivots, which reach the driver and every task: 64 x 384 dimensions are 200 KB.
PIVOTS = 64
#: Rows of a block, and queries that visit a block together, about.
BLOCK, VISITORS = 8192, 4096
#: Width of a ring, radians.
RING = 0.05
#: Angles are widened by this much: what rounding can take from an arc cosine.
SLACK = 1e-6
#: Cell of the zero references.
ZERO = -1


def _pivots(refs: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` distinct unit vectors, by the hash of the vector."""
    rows = refs.where("not zero").select("vec").distinct().orderBy(F.xxhash64("vec")).limit(n).collect()
    return unit_rows([r.vec for r in rows]) if rows else np.zeros((0, 1))


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1, 1))


def build(refs: DataFrame, ref_id: str = "ref_id", ref_vec: str = "vec", ref_label: str = "label",
          pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(index rows, pivots): ref_id, ref_label, vec, cell, ring, angle, zero."""
    r = refs.select(F.col(ref_id).alias("ref_id"), F.col(ref_label).alias("ref_label"),
                    F.col(ref_vec).cast("array<double>").alias("vec")).where("vec is not null")
    r = r.select("*", F.forall("vec", lambda x: x == 0).alias("zero"))
    chosen = _pivots(r, pivots)
    schema = T.StructType([*r.schema, T.StructField("cell", T.IntegerType()), T.StructField("ring", T.IntegerType()),
                           T.StructField("angle", T.DoubleType())])

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            zero = b.column("zero").to_numpy(zero_copy_only=False)
            cell, angle = np.full(len(zero), ZERO, np.int32), np.full(len(zero), np.pi / 2)
            if len(chosen):
                a = _angles(unit_rows(b.column("vec").to_numpy(zero_copy_only=False)), chosen)
                near = a.argmin(1)
                cell[~zero], angle[~zero] = near[~zero], a[np.arange(len(a)), near][~zero]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell), pa.array((angle / RING).astype(np.int32)), pa.array(angle)], names=schema.names)

    return r.mapInArrow(place, schema), chosen


def _rings(index: DataFrame) -> DataFrame:
    """A row a ring: its angles, its rows, and the number of its blocks."""
    return index.groupBy("cell", "ring").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("rows"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))


def _bounds(angles: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least angle of each query (row) to any member of each ring."""
    if not angles.shape[1]:
        return np.full((len(angles), len(cell)), np.pi / 2 - SLACK)
    d = angles[:, np.maximum(cell, 0)]
    # a member m at angle r from the pivot: |d - r| <= angle(q, m)
    out = np.maximum(0, np.maximum(low - d, d - high)) - SLACK
    return np.where(cell == ZERO, np.pi / 2 - SLACK, out)


def _block(key, q, r, k: int, fields):
    """Best ``k`` of one block for the queries that visit it."""
    if not q.num_rows or not r.num_rows:
        return pa.table({f.name: pa.array([], f.type) for f in fields}, schema=fields)
    r = r.sort_by("ref_id").combine_chunks()
    q = q.combine_chunks()
    at, sim = tile_topk(unit_rows(q.column("vec").to_numpy()), unit_rows(r.column("vec").to_numpy()), k)
    row = pa.array(np.repeat(np.arange(q.num_rows), at.shape[1]))
    at = pa.array(at.ravel())
    return pa.table([q.column("query_id").take(row), q.column("key").take(row), r.column("ref_id").take(at),
                     r.column("ref_label").take(at), pa.array(sim.ravel())], schema=fields)


def topk(queries: DataFrame, refs: DataFrame, k: int = S.KNN_K, query_id: str = "query_id",
         query_vec: str = "vec", ref_id: str = "ref_id", ref_vec: str = "vec", ref_label: str = "label",
         pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(top-k as ``knn.similarity_topk``, visits): visits has (step, visits, of), the (query, ring)
    pairs that were visited in each step and that there are."""
    spark = queries.sparkSession
    index, chosen = build(refs, ref_id, ref_vec, ref_label, pivots)
    index = written(spark, index, "knn-index")
    rings = written(spark, _rings(index), "knn-rings")  # at most (pivots + 1) x (pi / RING + 1) rows, a few thousand
    table = rings.orderBy("cell", "ring").toArrow()
    cell, low, high, rows, blocks = (table.column(c).to_numpy() for c in ("cell", "low", "high", "rows", "blocks"))
    ring = table.column("ring").to_numpy()

    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec"))
    q = q.where("vec is not null").select("*", F.xxhash64("vec").alias("key"), F.forall("vec", lambda x: x == 0).alias("zero"))
    q = written(spark, q.dropDuplicates(["query_id", "key"]), "knn-queries")

    index = index.join(F.broadcast(rings.select("cell", "ring", "blocks")), ["cell", "ring"]).select(
        "ref_id", "ref_label", "vec", "cell", "ring", F.pmod(F.xxhash64("ref_id", "vec"), "blocks").cast("int").alias("block"))
    kinds = {f.name: f.dataType for f in q.schema} | {f.name: f.dataType for f in index.schema}
    spot = "query_id {0}, key long, vec array<double>, cell int, ring int, block int, first boolean".format(
        kinds["query_id"].simpleString())
    out = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("key", T.LongType()),
                        T.StructField("ref_id", kinds["ref_id"]), T.StructField("ref_label", kinds["ref_label"]),
                        T.StructField("similarity", T.DoubleType())])

    def visit(limit_column: bool):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    if not part.num_rows or not len(cell):
                        continue
                    m = unit_rows(part.column("vec").to_numpy(zero_copy_only=False))
                    least = _bounds(_angles(m, chosen) if len(chosen) else np.zeros((len(m), 0)), cell, low, high)
                    order = np.argsort(least, axis=1, kind="stable")
                    upto = np.cumsum(rows[order], axis=1)
                    near = np.zeros(least.shape, bool)  # the nearest rings that hold k references
                    np.put_along_axis(near, order, np.concatenate([np.zeros((len(m), 1), np.int64), upto[:, :-1]], 1) < k, 1)
                    take = near
                    if limit_column:
                        worst = part.column("worst").to_numpy(zero_copy_only=False)
                        limit = np.where(np.isnan(worst), np.inf, np.arccos(np.clip(worst, -1, 1)))
                        take = ~near & (least <= limit[:, None] + SLACK)
                    i, j = np.nonzero(take)
                    n = blocks[j]
                    i, j = np.repeat(i, n), np.repeat(j, n)
                    nth = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(pa.array(i)), part.column("key").take(pa.array(i)),
                         part.column("vec").take(pa.array(i)), pa.array(cell[j]), pa.array(ring[j]),
                         pa.array(nth.astype(np.int32)), pa.array(nth == 0)],
                        names=["query_id", "key", "vec", "cell", "ring", "block", "first"])
        return run

    def search(visits: DataFrame) -> DataFrame:
        # many queries of one block are dealt into parts, each with its copy of the block
        keys = ["cell", "ring", "block"]
        parts = visits.groupBy(*keys).agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
        asks = visits.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("query_id", "key"), "parts").cast("int"))
        copies = parts.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        held = index.join(copies, keys)
        fields = pa.schema([(f.name, t) for f, t in zip(out, map(_arrow, out))])
        return asks.groupBy(*keys, "part").cogroup(held.groupBy(*keys, "part")).applyInArrow(
            lambda key, a, b: _block(key, a, b, k, fields), out)

    best = Window.partitionBy("query_id", "key").orderBy(F.col("similarity").desc(), F.col("ref_id"))

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    real = q.where("not zero")
    first = written(spark, real.mapInArrow(visit(False), spot), "knn-visits")
    found = written(spark, ranked(search(first)), "knn-first")
    worst = found.groupBy("query_id", "key").agg(F.when(F.max("rank") == k, F.min("similarity")).alias("worst"))
    on = real["query_id"].eqNullSafe(worst["query_id"]) & (real["key"] == worst["key"])
    bounded = real.join(worst, on, "left").select(real["query_id"], real["key"], real["vec"], "worst")
    second = written(spark, bounded.mapInArrow(visit(True), spot), "knn-visits")
    every = ranked(found.select(*out.names).unionByName(search(second)))
    least = index.select(F.struct("ref_id", "ref_label").alias("x")).orderBy("x.ref_id").limit(k)
    least = least.agg(F.sort_array(F.collect_list("x"))).scalar()
    blank = q.where("zero").select("query_id", F.posexplode(least).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.ref_id", "x.ref_label", F.lit(0.0).alias("similarity"))
    seen = first.select(F.lit(1).alias("step"), "first").unionAll(second.select(F.lit(2), "first")).where("first")
    pairs = real.agg(F.count("*") * F.lit(len(cell))).scalar()
    visits = seen.groupBy("step").agg(F.count("*").alias("visits")).select("*", pairs.alias("of"))
    return every.select(*TOPK_FIELDS).unionByName(blank), visits


def _arrow(field: T.StructField):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(field.dataType)
