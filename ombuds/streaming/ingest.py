"""Structured Streaming re-aims of the reference's rerun-on-upload loop.

R1 -- incremental ingest of a landing folder with keep-first de-duplication by key.
R2 -- running weekly counts: event-time tumbling windows of 7 days starting on
      Monday (``window(ts, '7 days', '7 days', '4 days')``: the epoch is a
      Thursday), without a watermark: no row is too late. Running monthly counts by a
      state keyed by calendar month.

Both sinks are ``foreachBatch`` writes into the shared checkpoint folder: each
micro-batch is written under its own ``batch_id`` partition (overwrite of that
partition only), so a retried batch replaces its own output -- idempotent under
executor loss. The stream checkpoint lives next to it. State uses the RocksDB
provider when the session allows setting it, so key state spills to local disk
instead of executor heap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(spark: SparkSession) -> None:
    try:
        if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", None):
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    except Exception:  # noqa: BLE001 - immutable on some platforms; default provider then
        pass


def _folder(spark: SparkSession, path: str) -> None:
    """Make a folder, so that an output without rows can be read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def _run(stream: DataFrame, batch, ckpt: str, mode: str) -> None:
    """One run over what has landed. It ends with its last data: a batch without data would move the bound for
    late rows, so that the next run on this checkpoint dropped rows which one run over all files keeps."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name, None)
    conf.set(name, "false")
    try:
        (stream.writeStream.outputMode(mode).foreachBatch(batch)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def stream_dedupe(spark: SparkSession, sources: list[DataFrame], key: str = S.KEY,
                  run_id: str | None = None) -> DataFrame:
    """Union of streaming sources, first arrival per key kept.

    Each micro-batch is reduced to one row per key (a grouped minimum, reduced in each task, so
    a hot or null key is no burden) and merged against the keys that earlier batches stored.
    There is no streaming state to grow, and a second run on the same ``run_id`` skips the
    files that the first has seen."""
    base = shared_dir(spark, f"stream_dedupe_{run_id or uuid.uuid4().hex}")
    out = f"{base}/out"
    u = sources[0]
    for s in sources[1:]:
        u = u.unionByName(s, allowMissingColumns=True)
    schema = T.StructType([*u.schema, T.StructField("batch_id", T.LongType())])

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        rows = batch.select(F.col(key).alias("_k"), F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("_r"),
                            F.monotonically_increasing_id().alias("_m"))
        first = rows.groupBy("_k").agg(F.min_by("_r", "_m").alias("_r"))
        _folder(own, out)
        known = own.read.schema(schema).parquet(out).where(F.col("batch_id") != batch_id).select(F.col(key).alias("_o"))
        new = first.join(known, F.col("_k").eqNullSafe(F.col("_o")), "left_anti").select("_r.*")
        (new.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    _run(u, merge, f"{base}/ckpt", "append")
    _folder(spark, out)
    return spark.read.schema(schema).parquet(out).drop("batch_id")


def _running_counts(spark: SparkSession, agg: DataFrame, keys: list[str], name: str, run_id: str | None) -> DataFrame:
    """Write each batch's changed counts under its own id; the latest count of each key."""
    _use_rocksdb(spark)
    base = shared_dir(spark, f"{name}_{run_id or uuid.uuid4().hex}")
    out = f"{base}/out"
    schema = T.StructType([*agg.schema, T.StructField("batch_id", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    _run(agg, write, f"{base}/ckpt", "update")
    _folder(spark, out)
    return spark.read.schema(schema).parquet(out).groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"))


def stream_monthly_counts(spark: SparkSession, events: DataFrame, ts: str, group: str,
                          run_id: str | None = None) -> DataFrame:
    """R2, monthly: counts per calendar month and ``group`` from an event stream. Months differ in
    length, so they are no ``window``: the state is keyed by the month's first day.

    There is no watermark: files arrive in any order and every row counts, however late. Rows
    without a time are left out. The state is one number per month and group."""
    month = F.to_date(F.date_trunc("month", F.col(ts).cast("timestamp"))).alias("month")
    agg = events.where(F.col(ts).isNotNull()).groupBy(month, F.col(group)).agg(F.count(F.lit(1)).alias("n"))
    return _running_counts(spark, agg, ["month", group], "stream_monthly", run_id)


def stream_dedupe_watermark(spark: SparkSession, events: DataFrame, key: str, ts: str, delay: str = "1 day",
                            run_id: str | None = None) -> DataFrame:
    """R1 with bounded state: the first row of each key; a repetition within ``delay`` of it is
    dropped, a later one is a new record.

    ``dropDuplicatesWithinWatermark`` keeps a key in the (RocksDB) state until the watermark, the
    largest time seen less ``delay``, has passed the key's time by ``delay``, so the state holds the
    keys of about that span. Rows older than the watermark are dropped by Spark."""
    _use_rocksdb(spark)
    base = shared_dir(spark, f"stream_dedupe_watermark_{run_id or uuid.uuid4().hex}")
    out = f"{base}/out"
    schema = T.StructType([*events.schema, T.StructField("batch_id", T.LongType())])
    first = (events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", delay)
                   .dropDuplicatesWithinWatermark([key]).drop("_t"))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    _run(first, write, f"{base}/ckpt", "append")
    _folder(spark, out)
    return spark.read.schema(schema).parquet(out).drop("batch_id")


def stream_weekly_counts(spark: SparkSession, events: DataFrame, ts: str, group: str,
                         run_id: str | None = None) -> DataFrame:
    """R2: weekly counts per ``group`` from an event stream; update mode, so each window's
    latest count is the one with the highest batch id.

    There is no watermark: files arrive in any order and every row counts, however late. The
    state is one number per week and group."""
    agg = (events.withColumn("_t", F.col(ts).cast("timestamp"))
                 .groupBy(F.window("_t", "7 days", "7 days", "4 days").alias("w"), F.col(group))
                 .agg(F.count(F.lit(1)).alias("n"))
                 .select(F.to_date(F.col("w.start")).alias("week_start"), group, "n"))
    return _running_counts(spark, agg, ["week_start", group], "stream_weekly", run_id)
