"""Exact top-k inner products with a pivot-distance index.

Vectors are turned into integers (floor of a scaled component) and lifted by one component
so that all have the same norm; then the largest inner product is the smallest distance.
Each vector belongs to its nearest pivot and is keyed by (pivot, distance to it); a cell,
sorted by distance, is cut into annuli of at most ``BLOCK`` vectors. By the triangle
inequality a vector at distance r from a pivot is at least ``|d(query, pivot) - r|`` away
from the query. Annuli are expanded in the order of that bound: first the nearest of each
query, which gives its k-th best distance so far, then every other annulus whose bound does
not exceed it. A search stops when no bound is left. Pivots are a bounded sample of the
vectors (by hash order); every vector is indexed, so the result is exact.

Queries travel in chunks of the same pivot, annuli as packed matrices; a kernel multiplies a
chunk by an annulus and keeps k rows of each query. Nothing is broadcast but pivots and the
annuli's bounds per pivot chunk.

Vectors whose inner products floats may round (a component of 2**23 or more after scaling, or a
squared norm of 2**52) are kept apart: as queries they meet all vectors, as candidates all
queries, in blocks without bounds. There floats only choose what can be among the k best, with
the rounding allowed for; the scores of those are sums of whole numbers without a limit.

Defined results: vectors that are null, or hold null or non-finite components, or have
another length than the most frequent one, take no part, nor do rows without an id. Rows are
told apart by a number of their own: of rows that repeat an id each is a candidate, also of the
others, and each that is a query has ranks of its own. Of equal scores the smaller id comes
first; an empty table gives no rows. Ranks follow the exact scores; a score beyond a long is shown as the nearest long. Other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

PIVOTS = 8
#: Vectors of an annulus, unless there would be more than MOST_BLOCKS annuli; their bounds are broadcast.
BLOCK, MOST_BLOCKS = 2048, 20_000
CHUNK = 1024
SCALE = 256.0
#: Integers and squared norms below these have inner products that are exact in floats.
LARGEST, LARGEST_NORM2 = float(1 << 23), float(1 << 52)
#: Allowance for rounding in distances of integers.
SLACK = 1e-6


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<long>, x array<double>) of the rows that take part: ``v`` where floats are exact, else ``x``."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, x: a + (F.abs(x) * SCALE + 1) * (F.abs(x) * SCALE + 1))
    small = F.forall("x", lambda x: F.abs(x) < LARGEST / SCALE) & (norm2 < LARGEST_NORM2)
    return v.select("id", F.when(small, F.transform("x", lambda x: F.floor(x * SCALE))).alias("v"),
                    F.when(~small, F.col("x")).alias("x"))


def integers(x: np.ndarray) -> list[int]:
    """floor(x * SCALE) without a limit."""
    return [int(a) * int(SCALE) if abs(a) > 2.0 ** 60 else math.floor(a * SCALE) for a in x.tolist()]


def sort_key(score: int) -> bytes:
    """Bytes that sort like the number."""
    n = abs(score)
    size = (n.bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + n.to_bytes(size, "big")
    return b"\x01" + raw if score >= 0 else b"\x00" + bytes(255 - c for c in raw)


def as_long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


EXACT = "query_row long, query_id long, vec_id long, score long, key binary"


def exact_rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """A batch of ``EXACT`` from (query row, query id, vector id, score)."""
    return pa.RecordBatch.from_arrays(
        [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)),
         pa.array([as_long(r[3]) for r in rows], pa.int64()), pa.array([sort_key(r[3]) for r in rows], pa.binary())],
        names=["query_row", "query_id", "vec_id", "score", "key"])


def exact_best(qrows: np.ndarray, qids: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, m: np.ndarray,
               k: int) -> list[tuple[int, int, int, int]]:
    """(query row, query id, vector id, score) of the k best of each query of one block, in whole numbers."""
    def floats(x):  # the whole numbers over 2**32
        return np.where(np.abs(x) < 2.0 ** 45, np.floor(np.where(np.abs(x) < 2.0 ** 45, x, 0) * SCALE) / 2.0 ** 32, x / 2.0 ** 24)

    fq, fm = floats(q), floats(m)
    fq = np.ldexp(fq, -np.frexp(np.abs(fq).max(1))[1][:, None])
    near = fq @ fm.T
    width = q.shape[1]
    error = 1e-15 * width * (width + 4) * np.abs(fm).max(1)
    own = qrows[:, None] == rows[None, :]
    low, high = np.where(own, -np.inf, near - error), near + error
    floor = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(qids), -np.inf)
    can = ~own & (high >= floor[:, None])
    whole_m: dict[int, list[int]] = {}
    out = []
    for i in np.flatnonzero(can.any(1)):
        a = integers(q[i])
        got = []
        for j in np.flatnonzero(can[i]).tolist():
            if j not in whole_m:
                whole_m[j] = integers(m[j])
            got.append((-sum(x * y for x, y in zip(a, whole_m[j])), int(ids[j])))
        out += [(int(qrows[i]), int(qids[i]), j, -n) for n, j in sorted(got)[:k]]
    return out


def search_large(small: DataFrame, large: DataFrame, is_query, width: int, k: int) -> DataFrame:
    """``EXACT`` rows of the pairs of (row, id, x) vectors with a large one among them, some of which are not the k best."""
    spark = large.sparkSession

    def pack(key, t):
        x = np.stack(t.column("x").to_numpy()).astype("<f8")
        return pa.table({"rows": [whole_bytes(t, "row")], "ids": [whole_bytes(t, "id")], "m": [x.tobytes()]})

    def packed(rows, size):
        rows = written(spark, rows, "large")
        parts = max(1, -(-rows.count() // size))
        of = F.pmod(F.xxhash64("row"), F.lit(parts))
        out = rows.select("row", "id", "x", of.alias("part")).groupBy("part").applyInArrow(
            pack, "rows binary, ids binary, m binary")
        return written(spark, out, "large-blocks")

    def kernel(batches):
        for b in batches:
            for row in b.to_pylist():
                qrows, qids, own, ids = (np.frombuffer(row[c], "<i8") for c in ("qrows", "qids", "rows", "ids"))
                q, m = (np.frombuffer(row[c], "<f8").reshape(-1, width) for c in ("q", "m"))
                rows = exact_best(qrows, qids, q, own, ids, m, k)
                if rows:
                    yield exact_rows(rows)

    of_small, of_large = packed(small, BLOCK), packed(large, BLOCK)
    asked = is_query(F.col("id"))
    asking = [packed(rows.where(asked), CHUNK).withColumnsRenamed({"rows": "qrows", "ids": "qids", "m": "q"}) for rows in (small, large)]
    pairs = asking[1].crossJoin(of_small.unionByName(of_large)).unionByName(asking[0].crossJoin(of_large))
    return pairs.select("qrows", "qids", "q", "rows", "ids", "m").repartition(spark.sparkContext.defaultParallelism).mapInArrow(kernel, EXACT)


def whole_bytes(t: pa.Table, column: str) -> bytes:
    return t.column(column).to_numpy().astype("<i8").tobytes()


class Pivots:
    """Pivots and the common norm of the lifted vectors."""

    def __init__(self, at: np.ndarray, norm2: float):
        self.norm2 = norm2
        self.at = self.lift(at)

    def lift(self, v: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.norm2 - (v * v).sum(1))
        return np.concatenate([v, np.sqrt(rest)[:, None]], 1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d2 = (lifted * lifted).sum(1)[:, None] + (self.at * self.at).sum(1) - 2 * lifted @ self.at.T
        return np.sqrt(np.maximum(0.0, d2))


def matrix(col) -> np.ndarray:
    """[rows, width] floats of an Arrow list column whose lists are equally long."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(col), -1)


def top_rows(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row; of equals the first column, so ids must ascend."""
    n = score.shape[1]
    if n > 8 * k:
        floor = np.partition(score, n - k, axis=1)[:, n - k:n - k + 1]
        out = np.empty((len(score), k), np.int64)
        for i, row in enumerate(score >= floor):  # ties can make it more than k
            cols = np.flatnonzero(row)
            out[i] = cols[np.argsort(-score[i, cols], kind="stable")[:k]]
        return out
    return np.argsort(-score, axis=1, kind="stable")[:, :k]


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query(id column)`` holds."""
    spark = vectors.sparkSession
    numbered = whole(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id())
    base = written(spark, numbered, "vectors")  # the numbers are fixed from here on
    size = F.size(F.coalesce(F.col("v").cast("array<double>"), "x"))
    shape = (base.groupBy(size.alias("w")).agg(F.count("*").alias("n"), F.count("v").alias("small"))
             .orderBy(F.desc("n"), "w").first())
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    base = base.where(size == shape.w)
    small, large = (base.where(F.col(c).isNotNull()).select("row", "id", c) for c in ("v", "x"))
    if shape.small == shape.n:
        out, order = search_small(small, is_query, shape.w, k), F.desc("score")
    else:
        def keyed(batches):
            for b in batches:
                if b.num_rows:
                    yield exact_rows(list(zip(*(c.to_pylist() for c in b.columns))))

        raw = small.select("row", "id", F.transform("v", lambda x: x / F.lit(SCALE)).alias("x"))
        out, order = search_large(raw, large, is_query, shape.w, k), F.desc("key")
        if shape.small:
            out = out.unionByName(search_small(small, is_query, shape.w, k).mapInArrow(keyed, EXACT))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(order, "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_small(base: DataFrame, is_query, width: int, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score) of the best pairs of (row, id, v array<long>) vectors, some of which are not
    the k best."""
    spark = base.sparkSession
    norm2 = base.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("n")).agg(F.max("n"))
    norm2 = float(norm2.first()[0])
    sample = base.orderBy(F.xxhash64("v"), "id").limit(PIVOTS).collect()
    pivots = spark.sparkContext.broadcast(Pivots(np.array([r.v for r in sample], float), norm2))

    def assign(batches):
        p = pivots.value
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(2))
                d = p.distances(p.lift(v))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                    names=["row", "id", "v", "pivot", "dist"])

    vector = "row long, id long, v array<long>, pivot int, dist double"
    placed = written(spark, base.mapInArrow(assign, vector), "placed")
    # Ranks inside a cell without one task per cell: distances are cut at sampled quantiles,
    # and what falls between two cuts is dealt evenly when equal distances overfill it.
    counts = placed.groupBy("pivot").count().collect()
    block = max(BLOCK, -(-sum(r["count"] for r in counts) // MOST_BLOCKS))
    cuts = {}
    for r in counts:
        parts = -(-r["count"] // block)
        cuts[r.pivot] = parts
    several = {p: n for p, n in cuts.items() if n > 1}
    edges: dict[int, list[float]] = {p: [] for p in cuts}
    if several:
        most = max(several.values())
        got = (placed.where(F.col("pivot").isin(list(several))).groupBy("pivot")
               .agg(F.percentile_approx("dist", [i / most for i in range(1, most)], 10_000).alias("e")).collect())
        for r in got:
            n = several[r.pivot]
            edges[r.pivot] = sorted({r.e[min(most - 2, round(i * most / n) - 1)] for i in range(1, n)})
    shared = spark.sparkContext.broadcast({p: np.array(e) for p, e in edges.items()})

    def block_of(batches):
        cut = shared.value
        for b in batches:
            if b.num_rows:
                pv, d = np.asarray(b.column("pivot")), np.asarray(b.column("dist"))
                ring = np.zeros(len(pv), np.int64)
                for p in np.unique(pv):
                    ring[pv == p] = np.searchsorted(cut[p], d[pv == p], "right")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring)], names=[*b.schema.names, "ring"])

    ringed = placed.mapInArrow(block_of, vector + ", ring long")
    sizes = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    ringed = ringed.join(sizes, ["pivot", "ring"]).withColumn(
        "part", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / block)))

    def pack(key, t):
        t = t.sort_by([("id", "ascending"), ("row", "ascending")])
        v = matrix(t.column("v").combine_chunks())
        d = t.column("dist").to_numpy()
        return pa.table({"pivot": pa.array([key[0].as_py()], pa.int32()), "ring": [key[1].as_py()], "part": [key[2].as_py()],
                         "near": [float(d.min())], "far": [float(d.max())],
                         "rows": [whole_bytes(t, "row")], "ids": [whole_bytes(t, "id")], "m": [v.astype("<i4").tobytes()]})

    blocks = (ringed.select("pivot", "ring", "part", "row", "id", "v", "dist").groupBy("pivot", "ring", "part")
              .applyInArrow(pack, "pivot int, ring long, part long, near double, far double, rows binary, ids binary, m binary"))
    blocks = written(spark, blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")

    chosen = placed.where(is_query(F.col("id")))
    total = chosen.groupBy("pivot").count().withColumnRenamed("count", "n")
    chunked = chosen.join(total, "pivot").withColumn("c", F.pmod(F.xxhash64("row", F.lit(1)), F.ceil(F.col("n") / CHUNK)))

    def pack_queries(key, t):
        v = matrix(t.column("v").combine_chunks())
        return pa.table({"home": pa.array([key[0].as_py()], pa.int32()),
                         "qrows": [whole_bytes(t, "row")], "qids": [whole_bytes(t, "id")], "q": [v.astype("<i4").tobytes()]})

    chunks = (chunked.select("pivot", "c", "row", "id", "v").groupBy("pivot", "c")
              .applyInArrow(pack_queries, "home int, qrows binary, qids binary, q binary"))
    chunks = written(spark, chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")

    def unpack(row):
        q = np.frombuffer(row["q"], "<i4").astype(float).reshape(-1, width)
        return np.frombuffer(row["qrows"], "<i8"), np.frombuffer(row["qids"], "<i8"), q

    def kernel(batches):
        """Best k of each query of a chunk in one annulus, if its bound reaches the query's floor."""
        p = pivots.value
        for b in batches:
            for row in b.to_pylist():
                qrows, qids, q = unpack(row)
                ids, m = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["m"], "<i4").astype(float).reshape(-1, width)
                floor = np.frombuffer(row["floor"], "<f8") if row["floor"] is not None else None
                if floor is not None:
                    can = bounds(p, q, row["pivot"], row["near"], row["far"]) >= floor
                    qrows, qids, q = qrows[can], qids[can], q[can]
                if not len(q):
                    continue
                score = q @ m.T  # exact: norms, so all sums of products, are below 2**53
                score[qrows[:, None] == np.frombuffer(row["rows"], "<i8")[None, :]] = -np.inf
                best = top_rows(score, min(k, len(ids)))
                got = np.take_along_axis(score, best, 1)
                ok = np.isfinite(got)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat(x, best.shape[1])[ok.ravel()]) for x in (qrows, qids)),
                     pa.array(ids[best].ravel()[ok.ravel()]), pa.array(got.ravel()[ok.ravel()].astype(np.int64))],
                    names=["query_row", "query_id", "vec_id", "score"])

    def bounds(p: Pivots, q: np.ndarray, pivot: int, near: float, far: float) -> np.ndarray:
        """Highest inner product that a vector of an annulus can have with each query."""
        q2 = (q * q).sum(1)
        lifted = np.concatenate([q, np.zeros((len(q), 1))], 1)
        d = np.sqrt(np.maximum(0.0, q2 + p.norm2 - 2 * lifted @ p.at[pivot]))
        rounding = 2 * np.sqrt(8 * (width + 8) * np.finfo(float).eps * p.norm2)  # of two distances
        gap = np.maximum(0.0, np.maximum(near - d, d - far) - SLACK - rounding)
        return (q2 + p.norm2 - gap * gap) / 2 + SLACK * (1 + p.norm2)

    rings = blocks.select("block", "pivot", "near", "far")

    def plan(batches, rows, first):
        p = pivots.value
        for b in batches:
            for row in b.to_pylist():
                _, _, q = unpack(row)
                best = np.stack([bounds(p, q, r.pivot, r.near, r.far) for r in rows], 1)
                if first:  # the annuli that are nearest to some query of the chunk
                    want = np.unique(best.argmax(1))
                else:
                    floor = np.frombuffer(row["floor"], "<f8")
                    want = np.flatnonzero((best >= floor[:, None]).any(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(want), pa.int64()), pa.array([rows[i].block for i in want], pa.int64())],
                    names=["chunk", "block"])

    result = "query_row long, query_id long, vec_id long, score long"
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    bound_rows = spark.sparkContext.broadcast(rings.collect())  # four numbers per annulus of BLOCK vectors
    no_floor = chunks.withColumn("floor", F.lit(None).cast("binary"))
    near = no_floor.mapInArrow(lambda it: plan(it, bound_rows.value, True), "chunk long, block long")
    first = written(spark, no_floor.join(near, "chunk").join(blocks, "block").mapInArrow(kernel, result), "first")
    kth = (first.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k)
           .select("query_row", F.col("score").cast("double").alias("floor")))

    def rows_of(batches):
        for b in batches:
            for row in b.to_pylist():
                qrows = np.frombuffer(row["qrows"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(qrows), pa.int64()), pa.array(qrows),
                                                  pa.array(np.arange(len(qrows)))], names=["chunk", "query_row", "i"])

    members = chunks.mapInArrow(rows_of, "chunk long, query_row long, i long").join(kth, "query_row", "left")

    def pack_floor(key, t):
        t = t.sort_by("i")
        floor = np.nan_to_num(t.column("floor").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        return pa.table({"chunk": [key[0].as_py()], "floor": [floor.tobytes()]})

    floors = members.groupBy("chunk").applyInArrow(pack_floor, "chunk long, floor binary")
    floored = written(spark, chunks.join(floors, "chunk"), "floors")
    rest = (floored.mapInArrow(lambda it: plan(it, bound_rows.value, False), "chunk long, block long")
            .join(near, ["chunk", "block"], "left_anti"))
    more = floored.join(rest, "chunk").join(blocks, "block").mapInArrow(kernel, result)
    return first.unionByName(more)
