"""Landings of many files, a run each."""

import os

from pyspark.sql import functions as F

from ombuds.plans import queries
from ombuds.session import shared_dir
from ombuds.sources.tables import table
from ombuds.streaming import ingest as streams


def test_runs_keep_what_one_run_keeps(spark):
    """Three files as three batches of one run, and as three landings of several files, a run each."""
    schema = "k long, ts timestamp_ntz"
    part = [[(i + 2 * d, f"2024-0{1 + i % 3}-{d:02d} 00:00:00") for i in range(60)] for d in (1, 12, 25)]
    part = [spark.createDataFrame(p + p[:20], "k long, ts string").select("k", F.col("ts").cast("timestamp_ntz")) for p in part]
    one, many = (shared_dir(spark, f"test-{os.urandom(6).hex()}") for _ in range(2))
    run = os.urandom(6).hex()
    for p in part:
        p.coalesce(1).write.mode("append").parquet(one)
        p.repartition(4).write.mode("append").parquet(many)
        got = streams.stream_dedupe_watermark(spark, spark.readStream.schema(schema).parquet(many), "k", "ts", run_id=run)
    want = streams.stream_dedupe_watermark(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(one), "k", "ts")
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == rows and 60 < len(rows) < 180
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_landings_have_many_files(spark, monkeypatch):
    files = []
    real = streams.stream_dedupe_watermark

    def watched(own, stream, *a, run_id=None):
        files.append(own.read.parquet(shared_dir(own, f"landing-{run_id}")).inputFiles())
        return real(own, stream, *a, run_id=run_id)
    monkeypatch.setattr(streams, "stream_dedupe_watermark", watched)
    monkeypatch.setattr(queries, "table", lambda *a: table(*a).repartition(6))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert queries.REGISTRY["stream_dedupe_watermark"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(files) == 3 and len(files[0]) > 3
