"""CSV by header and quarantine, metric index, logs observed by the write, streams."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ombuds.operators import audit, knn, knn_index
from ombuds.session import shared_dir
from ombuds.sources import csv as C
from ombuds.sources.columns import map_columns
from ombuds.streaming import ingest as streams


def put(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


# ---- CSV ------------------------------------------------------------------------------------
def test_columns_follow_each_files_own_header(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "NU_REGISTRO;DS_ASSUNTO\n1;x\n2;y\n")
    put(tmp_path / "in", "b.csv", "DS_ASSUNTO;NU_REGISTRO\nz;3\n")
    put(tmp_path / "in", "c.csv", "NU_REGISTRO,DS_FILIAL\r\n4,loja\r\n")
    put(tmp_path / "in", "d.csv", "﻿DS_ASSUNTO;NU_REGISTRO\nw;5\n")
    put(tmp_path / "in", "e.csv", "DS_ASSUNTO;NU_REGISTRO\nação;6\n", "latin1")
    df = C.read_sniffed(spark, [str(tmp_path / "in")])[0]
    rows = {(r.NU_REGISTRO, r.DS_ASSUNTO, r.DS_FILIAL) for r in df.collect()}
    assert rows == {("1", "x", None), ("2", "y", None), ("3", "z", None), ("4", None, "loja"), ("5", "w", None),
                    ("6", "ação", None)}
    places = [r.row_id for r in df.orderBy("row_id").collect()]
    assert len(set(places)) == 6 and [r.NU_REGISTRO for r in df.orderBy("row_id").collect()] == list("123456")


def test_each_header_is_mapped_alone(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "id;categoria\n1;x\n")
    put(tmp_path / "in", "b.csv", "DS_ASSUNTO;NU_REGISTRO;resto\ny;2;r\n")
    plain = C.read_sniffed(spark, [str(tmp_path / "in")])[0]
    assert "id" in plain.columns and plain.where("NU_REGISTRO is not null").count() == 1
    df = C.read_sniffed(spark, [str(tmp_path / "in")], rename=map_columns)[0]
    assert {(r.NU_REGISTRO, r.DS_ASSUNTO, r.resto) for r in df.collect()} == {("1", "x", None), ("2", "y", "r")}


def test_quarantine(spark, tmp_path):
    put(tmp_path / "in", "a.csv", 'h1;h2;h3\n1;a;b\n2;"x;y";b\n3;a\n4;a;b;c\n5;"q ""r"" s";b\n6;a;b;c;d\n')
    put(tmp_path / "in", "b.csv", "h1;h2;h3\n7;a;b\n")
    good, bad = C.ingest_fixed(spark, str(tmp_path / "in"), ["a", "b", "c"], str(tmp_path / "out"))
    assert {tuple(r)[:3] for r in good.collect()} == {("1", "a", "b"), ("2", "x;y", "b"), ("3", "a", None), ("5", 'q "r" s', "b"),
                                                    ("7", "a", "b")}
    rows = bad.orderBy("_place").collect()
    assert [(r.raw_line, r.reason) for r in rows] == [("4;a;b;c", "4 fields, 3 expected"), ("6;a;b;c;d", "5 fields, 3 expected")]
    assert all(r._file.endswith("a.csv") for r in rows)
    put(tmp_path / "esc", "a.csv", 'h1;h2\n1;"x \\" y;z"\n2;a;b\n')
    good, bad = C.ingest_fixed(spark, str(tmp_path / "esc"), ["a", "b"], str(tmp_path / "out2"), escape="\\")
    assert [tuple(r)[:2] for r in good.collect()] == [("1", 'x " y;z')] and bad.count() == 1


# ---- nearest neighbours -----------------------------------------------------------------------
def brute(q, r, k):
    """Rows (query id, rank, reference id, similarity) by all pairs."""
    out = []
    unit = [knn.unit_rows([v])[0] for _, v in r]
    for i, v in q:
        s = sorted((-float(knn.unit_rows([v])[0] @ u), j) for (j, _), u in zip(r, unit))[:k]
        out += [(i, n + 1, j, round(-x + 0.0, 9) + 0.0) for n, (x, j) in enumerate(s)]
    return sorted(out)


def points(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(12, 10))
    return [(i, (centres[rng.integers(12)] + spread * rng.normal(size=10)).tolist()) for i in range(n)]


def frames(spark, q, r):
    return (spark.createDataFrame(q, "query_id long, vec array<double>").repartition(3),
            spark.createDataFrame([(i, v, f"l{i % 3}") for i, v in r], "ref_id long, vec array<double>, label string").repartition(4))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_index_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(knn_index, "BLOCK", 16)
    monkeypatch.setattr(knn_index, "VISITORS", 8)
    r = points(400, 1, spread) + [(1000 + i, [0.0] * 10) for i in range(3)] + [(2000, points(1, 1, spread)[0][1])]
    q = points(60, 2, spread) + [(500, [0.0] * 10), (3, r[7][1]), (3, r[8][1])]
    top, visits = knn_index.topk(*frames(spark, q, r), k=5, pivots=16)
    got = sorted((x.query_id, x.rank, x.ref_id, round(x.similarity, 9) + 0.0) for x in top.collect())
    assert got == brute(q, r, 5)
    seen = visits.collect()
    visited, of = sum(v.visits for v in seen), seen[0].of
    assert visited <= of and (spread > 0.1 or visited < of / 4)  # of well separated points most rings are skipped


def test_index_on_few_and_no_references(spark):
    q, r = frames(spark, points(5, 3, 1.0), points(3, 4, 1.0))
    assert knn_index.topk(q, r, k=5)[0].count() == 15
    assert knn_index.topk(q, r.limit(0), k=5)[0].count() == 0
    assert knn_index.topk(q.limit(0), r, k=5)[0].count() == 0


def test_references_lie_still(spark):
    """References are sent to blocks once, not once a query block."""
    q, r = frames(spark, points(50, 5, 0.1), points(200, 6, 0.1))
    top, _ = knn_index.topk(q, r, k=3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_repeated_query_ids_are_queries_of_their_own(spark):
    r = points(300, 7, 0.5)
    q = [(1, r[0][1]), (1, r[50][1]), (1, r[50][1]), (2, r[3][1])]
    top = knn.similarity_topk(*frames(spark, q, r), k=2, ref_block=64)
    got = sorted((x.query_id, x.rank, x.ref_id, round(x.similarity, 9)) for x in top.collect())
    assert got == brute(q[:2] + q[3:], r, 2)


# ---- logs -------------------------------------------------------------------------------------
def test_upload_is_counted_by_its_own_write(spark, tmp_path):
    seen = []
    rows = spark.range(1234).mapInArrow(lambda it: it, "id long")
    n = audit.write_logged(rows, str(tmp_path / "t"), str(tmp_path / "log"), "t.csv", "ana")
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert n == 1234 and not seen and [(x.filename, x.num_records, x.user) for x in log] == [("t.csv", 1234, "ana")]
    audit.append_uploads(spark.createDataFrame([("u.csv", 5)], "filename string, num_records int"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    audit.append_queries(spark.createDataFrame([("a", 3)], "query_type string, response_time_ms int"), str(tmp_path / "q"))
    assert spark.read.schema(audit.QUERY_SCHEMA).parquet(str(tmp_path / "q")).first().response_time_ms == 3.0


# ---- streams ----------------------------------------------------------------------------------
def land(spark, parts, schema):
    path = shared_dir(spark, f"test-land-{os.urandom(6).hex()}")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_monthly_counts_with_the_oldest_file_last(spark):
    schema = "ts string, g string"
    parts = [[("2024-03-31", "a"), ("2024-02-29", "a")], [("2024-03-01", "b"), (None, "a")], [("2024-02-01", "a"), ("1999-12-31", None)]]
    src = land(spark, parts, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(str(r.month), r.g, r.n) for r in streams.stream_monthly_counts(spark, src, "ts", "g").collect()}
    assert got == {("2024-03-01", "a", 1), ("2024-02-01", "a", 2), ("2024-03-01", "b", 1), ("1999-12-01", None, 1)}


def test_dedupe_within_the_watermark(spark):
    schema = "k string, ts string"
    parts = [[("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")],
             [("b", "2024-01-01 12:00:00"), ("c", "2024-01-09 00:00:00")],  # b again within the bound
             [("d", "2024-01-09 01:00:00")],
             [("a", "2024-01-09 02:00:00"), ("c", "2024-01-09 03:00:00")]]  # a beyond it, c within it
    src = land(spark, parts, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    run = os.urandom(6).hex()
    rows = streams.stream_dedupe_watermark(spark, src, "k", "ts", "1 day", run).collect()
    assert sorted(r.k for r in rows) == ["a", "a", "b", "c", "d"]
    again = streams.stream_dedupe_watermark(spark, src, "k", "ts", "1 day", run)  # no new files
    assert again.count() == 5


# ---- stored tables ----------------------------------------------------------------------------
def test_reference_versions(spark, tmp_path, monkeypatch):
    from ombuds import schema as S
    from ombuds.operators import features, reference
    from ombuds.sources import fixtures as fx
    t = fx.complaint_texts(spark, "/root/testdata/sf0.001").limit(150)
    path, encoder = str(tmp_path / "ref"), features.Md5Encoder(32)
    with pytest.raises(FileNotFoundError):
        reference.load_reference_set(spark, path)
    first = reference.build_reference_set(t, S.CATEGORY, path, encoder, max_rows=20, min_per_label=3)
    n = first.table.count()

    def lost(*a):
        raise OSError("lost")
    with monkeypatch.context() as m:  # a second build ends before it is published
        m.setattr(reference, "publish", lost)
        with pytest.raises(OSError):
            reference.build_reference_set(t, S.CATEGORY, path, encoder, max_rows=60, min_per_label=3)
    again = reference.load_reference_set(spark, path)
    assert again.version == first.version and again.table.count() == n == again.meta.total_records
    third = reference.build_reference_set(t, S.CATEGORY, path, encoder, max_rows=60, min_per_label=3)
    assert reference.versions(spark, path) == [first.version, third.version]
    assert reference.load_reference_set(spark, path).table.count() == third.table.count() > n
    assert again.table.count() == n  # a loaded version stays
    assert reference.load_reference_set(spark, path, first.version).meta.total_records == n
    reference.prune(spark, path, keep=1)
    assert reference.versions(spark, path) == [third.version]
    with pytest.raises(FileNotFoundError):
        reference.load_reference_set(spark, path, first.version)


def test_months_replace_and_prune(spark, tmp_path):
    import datetime as dt
    from ombuds import schema as S
    from ombuds.operators.kpi import date_filter
    from ombuds.sources import store
    path, ts = str(tmp_path / "months"), S.REGISTERED_AT
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=31 * i) for i in range(90)] + [None, None]
    rows = [(i, d) for i, d in enumerate(days)] + [(7, days[7])]
    t = spark.createDataFrame(rows, f"id long, {ts} timestamp").repartition(5)
    store.write_months(t, path)
    assert sorted(map(str, store.read_months(spark, path, t.schema).collect())) == sorted(map(str, t.collect()))
    period = (dt.date(2024, 2, 3), dt.date(2024, 3, 2))
    part = store.read_months(spark, path, t.schema, *period)
    want = date_filter(t, *period)
    assert sorted(r.id for r in part.collect()) == sorted(r.id for r in want.collect()) != []
    plan = part._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "month" in filters and "202402" in filters and "GreaterThanOrEqual" in plan.split("PushedFilters", 1)[1]
    later = spark.createDataFrame([(900, dt.datetime(2024, 2, 5))], t.schema)
    for _ in range(2):  # a repeated batch changes nothing
        store.write_months(later, path)
        got = store.read_months(spark, path, t.schema).collect()
        february = [r.id for r in got if r[ts] and (r[ts].year, r[ts].month) == (2024, 2)]
        assert february == [900] and len(got) == 1 + sum(1 for _, d in rows if not d or (d.year, d.month) != (2024, 2))
    store.write_months(t.limit(0), path)
    assert store.read_months(spark, path, t.schema).count() == len(got)
    with pytest.raises(ValueError):
        store.write_months(t.withColumn("month", F.lit(1)), path)
