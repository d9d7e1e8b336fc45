"""Exports of many files."""

import os

from pyspark.sql import functions as F

from ombuds.plans import queries
from ombuds.sources import csv as C


def test_an_export_of_many_files_keeps_its_order(spark, tmp_path):
    first = spark.range(1000, numPartitions=3).select(F.col("id").cast("string").alias("NU_REGISTRO"), F.lit("a\nb").alias("DS_OBSERVACAO"))
    again = first.withColumn("DS_OBSERVACAO", F.lit("repetido"))
    path = str(tmp_path / "export")
    C.write_csv(first.unionByName(again), path, max_rows=100)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) >= 20
    rows = C.read_sniffed(spark, [path])[0].orderBy("row_id").collect()
    assert [r.NU_REGISTRO for r in rows] == [str(i) for i in range(1000)] * 2
    assert {r.DS_OBSERVACAO for r in rows[:1000]} == {"a\nb"}


def test_exports_are_not_gathered_in_one_file(spark, monkeypatch):
    monkeypatch.setattr(queries, "EXPORT_ROWS", 50)
    written = []
    real = C.write_csv
    monkeypatch.setattr(C, "write_csv", lambda df, path, **k: (real(df, path, **k), written.append(spark.read.text(path).inputFiles())))
    assert queries.REGISTRY["csv_ingest"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(written[0]) > 5
