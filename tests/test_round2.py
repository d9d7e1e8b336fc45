"""Rules mended in this round: files as users have them, late rows, null keys, reference sets, plans."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ombuds import schema as S
from ombuds.functions import temporal as TM
from ombuds.functions import text as X
from ombuds.operators import autolabel, compare, features, forest, knn, quality, reference, sampling
from ombuds.operators.dedupe import keep_first
from ombuds.session import shared_dir
from ombuds.sources import csv as C
from ombuds.sources import fixtures as fx
from ombuds.sources import ingest
from ombuds.sources.columns import mapping_report
from ombuds.sources.tables import table
from ombuds.streaming import ingest as stream

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder():
    return tempfile.mkdtemp(prefix="ombuds-t-")


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def test_dialect_by_whole_path(spark):
    d = folder()
    write(f"{d}/export1/a.csv", "id;categoria\n1;Cobrança\n")
    write(f"{d}/export10/a.csv", "id;categoria\n2;Sé\n", "latin-1")
    one, ten = C.read_sniffed(spark, [f"{d}/export1", f"{d}/export10"])
    assert [r.categoria for r in one.collect()] == ["Cobrança"]
    assert [r.categoria for r in ten.collect()] == ["Sé"]


def test_quotes_and_line_breaks_round_trip(spark):
    d = folder()
    rows = [("1", 'disse "ola" hoje'), ("2", "linha um\nlinha dois"), ("3", "a;b,c"), ("4", None)]
    df = spark.createDataFrame(rows, "id string, t string")
    for sep, enc in ((";", "ISO-8859-1"), (",", "UTF-8")):
        C.write_csv(df, f"{d}/out{sep}", sep=sep, encoding=enc)
        back = C.read_sniffed(spark, [f"{d}/out{sep}"])[0]
        assert sorted((r.id, r.t) for r in back.collect()) == rows


def test_bad_rows_with_quoted_separators(spark):
    f = write(f"{folder()}/b.csv", 'A;B;C\n"x;y;z";2\n1;2;3;4\n5;6;7\n"q ""r;s""";"t;u";8\n')
    good, bad = C.read_fixed(spark, f, ["A", "B", "C"])
    assert sorted(tuple(r) for r in good.collect()) == [
        ("5", "6", "7"), ('q "r;s"', "t;u", "8"), ("x;y;z", "2", None)]
    assert [r.raw_line for r in bad.collect()] == ["1;2;3;4"]
    f = write(f"{folder()}/e.csv", 'A;B\n"x\\";y";2\n"p";q;r\n')
    good, bad = C.read_fixed(spark, f, ["A", "B"], escape="\\")
    assert [tuple(r) for r in good.collect()] == [('x";y', "2")] and bad.count() == 1


def test_first_row_of_a_file_wins(spark):
    lines = [f"k{i};v{i};x" for i in range(8)] + ["dup;first;x", "dup;second;x", ";null one;x", ";null two;x"]
    f = write(f"{folder()}/a.csv", "NU_REGISTRO;DS_ASSUNTO;DS_FILIAL\n" + "\n".join(lines) + "\n")
    out = {r.NU_REGISTRO: r.DS_ASSUNTO for r in ingest.ingest(C.read_sniffed(spark, [f])).collect()}
    assert len(out) == 10 and out["dup"] == "first" and out[None] == "null one"
    plain = spark.createDataFrame([("a", "one"), ("a", "two")], "NU_REGISTRO string, DS_ASSUNTO string").coalesce(1)
    assert [r.DS_ASSUNTO for r in ingest.ingest([plain]).collect()] == ["one"]


def test_keep_first_plan_and_hot_keys(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("int").alias("s"), F.col("id").alias("row_id"),
                                  F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id").cast("string")).alias("k"))
    out = keep_first(df, "k", ["s", "row_id"])
    assert out.count() == 2001 and out.where("k is null").first().row_id == 0
    assert "SortAggregate" not in plan(out)


def test_keep_first_keeps_one_row_of_each_key(spark):
    rows = [("a", 0, None, "x"), ("a", 0, None, "x"), ("b", 0, None, "late"), ("b", 0, 5, "first"),
            ("c", 0, 1, "one"), ("c", 0, 1, "two"), (None, None, None, "n"), (None, None, None, "n"), ("d", 0, 1, "d")]
    df = spark.createDataFrame(rows, "k string, s int, row_id int, v string").repartition(3)
    out = keep_first(df, "k", ["s", "row_id"])
    assert "WindowGroupLimit" in plan(out)
    got = [(r.k, r.v) for r in out.collect()]
    assert len(got) == 5 and {k for k, _ in got} == {"a", "b", "c", "d", None} and ("b", "first") in got
    text = spark.createDataFrame([("A-17", "k1", "x"), ("A-18", "k1", "y"), ("A-19", "k2", "z")],
                                 "row_id string, NU_REGISTRO string, DS_ASSUNTO string")
    assert sorted(r.NU_REGISTRO for r in ingest.ingest([text]).collect()) == ["k1", "k2"]
    d = folder()
    for name, value in (("a", "one"), ("b", "two")):
        write(f"{d}/{name}.csv", f"row_id;NU_REGISTRO;DS_ASSUNTO\n1;dup;{value}\n2;{name};x\n")
    out = {r.NU_REGISTRO: r.DS_ASSUNTO for r in ingest.ingest(C.read_sniffed(spark, [d])).collect()}
    assert out == {"dup": "one", "a": "x", "b": "x"}


def test_dates(spark):
    texts = ["1/2/2024", "2024-03-01T10:00:00Z", "2024-03-01 10:00:00.123", "2024-03-01T10:00:00+02:00", "31/12/2023 23:59",
             "2024-03-01", "n/a", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(
        TM.parse_timestamp("x").cast("string").alias("t")).collect()]
    assert got == ["2024-02-01 00:00:00", "2024-03-01 10:00:00", "2024-03-01 10:00:00.123", "2024-03-01 08:00:00",
                   "2023-12-31 23:59:00", "2024-03-01 00:00:00", None, None]


def test_late_files_count(spark):
    land, run = folder(), "late" + os.urandom(4).hex()
    totals = []
    for k, days in enumerate((["2024-03-11"], ["2024-01-03", "2024-01-04"], ["2024-01-05", "2024-02-06"])):
        rows = spark.createDataFrame([(d, "a") for d in days], "ts string, g string").select(F.col("ts").cast("timestamp"), "g")
        rows.coalesce(1).write.mode("append").parquet(land)
        out = stream.stream_weekly_counts(spark, spark.readStream.schema(rows.schema).parquet(land), "ts", "g", run)
        totals.append(out.agg(F.sum("n")).first()[0])
    assert totals == [1, 3, 5]


def test_stream_dedupe_runs_go_on(spark):
    land, run = folder(), "dd" + os.urandom(4).hex()
    counts = []
    for rows in ([("a", 1), ("a", 2), (None, 3)], [("a", 4), ("b", 5), (None, 6)], []):
        df = spark.createDataFrame(rows, "NU_REGISTRO string, v int")
        if rows:
            df.coalesce(1).write.mode("append").parquet(land)
        out = stream.stream_dedupe(spark, [spark.readStream.schema(df.schema).parquet(land)], run_id=run)
        counts.append(sorted((r.NU_REGISTRO or "", r.v) for r in out.collect()))
    assert counts == [[("", 3), ("a", 1)], [("", 3), ("a", 1), ("b", 5)], [("", 3), ("a", 1), ("b", 5)]]


def test_write_back_null_key_and_rejected(spark):
    t = spark.createDataFrame([(None, None), ("a", None), ("b", "B")], "k string, l string")
    p = spark.createDataFrame([(None, "N", 0.9, True), ("a", "A", 0.1, False)],
                              "k string, predicted string, confidence double, accepted boolean")
    got = {r.k: r.l for r in autolabel.write_back(t, p, "k", "l", F.col("l").isNull()).collect()}
    assert got == {None: "N", "a": None, "b": "B"}
    got = {r.k: r.l for r in forest.relabel(t, p, "k", "l", first_n=5).collect()}
    assert got == {None: "N", "a": None, "b": "B"}


TEXTS = [(str(i), "FRUIT" if i % 2 else "TOOL", "x" * 0 + ("apple pear plum " if i % 2 else "hammer saw drill ") * 4, "UVW")
         for i in range(40)]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [*TEXTS, ("q1", None, "apple plum " * 300, "ab"), ("q2", " outros ", "saw hammer saw", "UVW"),
            (None, None, "drill drill drill saw", "UVW"), ("s1", "TOOL", "ok", "OUTROS"), ("s1", "TOOL", "ok", None)]
    return spark.createDataFrame(rows, "NU_REGISTRO string, DS_ASSUNTO string, DS_OBSERVACAO string, SUB_ASSUNTO string")


@pytest.mark.parametrize("encoder", [features.HashedEncoder(64), features.Md5Encoder(64)])
def test_reference_set_and_labelling(spark, labelled, encoder):
    path = shared_dir(spark, "refs" + os.urandom(4).hex())
    built = reference.build_reference_set(labelled, S.CATEGORY, path, encoder, max_rows=20, min_per_label=3)
    ref = reference.load_reference_set(spark, path)
    assert ref.table.columns == ["ref_id", "label", "texto", "embedding"]
    assert ref.meta.total_records == 20 == built.table.count() and ref.meta.original_dataset_size == 40
    assert dict(ref.meta.categories) == {"FRUIT": 10, "TOOL": 10}
    out = autolabel.fill_labels(labelled, ref, threshold=0.4)
    text = plan(out)
    assert "Exchange" not in text and "Join" not in text and text.count("MapInArrow") == 1
    got = {r.NU_REGISTRO: r for r in out.where(X.needs_category("DS_ASSUNTO") | F.col("label_method").isNotNull()).collect()}
    assert {k: r.DS_ASSUNTO for k, r in got.items()} == {"q1": "FRUIT", "q2": "TOOL", None: "TOOL"}
    assert out.count() == labelled.count() and out.where("label_method is null").count() == 42


def test_short_subcategory_references_stay(spark, labelled):
    """F4 for sub-categories tests the label only."""
    df = labelled.select("NU_REGISTRO", F.lit("ab").alias("DS_OBSERVACAO"), "SUB_ASSUNTO").where("NU_REGISTRO < '5'")
    valid = sampling.valid_training_rows(df, "DS_OBSERVACAO", "SUB_ASSUNTO", sub=True)
    assert valid.count() == df.count() > 0


def test_autolabel_runs_both_passes_once(spark, labelled):
    out = autolabel.autolabel(labelled, encoder=features.Md5Encoder(64), threshold=0.3, max_rows=30)
    assert plan(out).count("MapInArrow") == 2 and "Exchange" not in plan(out)
    rows = out.collect()
    assert len(rows) == labelled.count()
    assert {"UVW", "ab"} <= {r.SUB_ASSUNTO for r in rows}
    assert {r.DS_ASSUNTO for r in rows if r.NU_REGISTRO in ("q2", None)} == {"TOOL"}


def test_set_topk_equals_blocked(spark, labelled):
    path = shared_dir(spark, "refs" + os.urandom(4).hex())
    ref = reference.build_reference_set(labelled, S.CATEGORY, path, features.Md5Encoder(64))
    q = ref.table.select(F.col("ref_id").alias("query_id"), F.col("embedding").alias("vec"))
    r = ref.table.select("ref_id", F.col("embedding").alias("vec"), "label")
    key = lambda x: (x.query_id, x.rank)
    a = sorted(knn.topk_in_set(q, ref, 3).collect(), key=key)
    b = sorted(knn.similarity_topk(q, r, 3, ref_block=16).collect(), key=key)
    assert [(x.query_id, x.rank, x.ref_id) for x in a] == [(x.query_id, x.rank, x.ref_id) for x in b]
    assert np.allclose([x.similarity for x in a], [x.similarity for x in b])


def test_too_large_a_set_is_refused(spark, labelled, monkeypatch):
    path = shared_dir(spark, "refs" + os.urandom(4).hex())
    ref = reference.build_reference_set(labelled, S.CATEGORY, path, features.Md5Encoder(64))
    monkeypatch.setattr(reference, "MAX_MATRIX_BYTES", 100)
    with pytest.raises(ValueError):
        ref.arrays()


def test_probe_short_text(spark, labelled):
    path = shared_dir(spark, "refs" + os.urandom(4).hex())
    ref = reference.build_reference_set(labelled, S.CATEGORY, path, features.Md5Encoder(64))
    probes = spark.createDataFrame([(1, "apple pear plum tree"), (2, "123456789"), (3, None)], "id int, t string")
    r = {x.id: x for x in autolabel.classify_probes(probes, ref, "t", "id", threshold=0.2).collect()}
    assert r[1].categoria == "FRUIT" and len(r[1].top_similares) == 3 and r[1].top_similares[0].endswith("...")
    for i in (2, 3):
        assert (r[i].categoria, r[i].confianca, r[i].metodo, r[i].top_similares) == (None, 0.0, "manual_review", [])


def test_snippets_and_accents(spark):
    r = spark.createDataFrame([(["a" * 150, "b", "c", "d"], " évÓÍ ")], "t array<string>, l string").select(
        X.snippets("t").alias("s"), X.normalize_label("l").alias("n")).first()
    assert r.s == ["a" * 100 + "...", "b...", "c..."] and r.n == "EVOI"


def test_missing_columns_and_unparseable_dates(spark):
    df = spark.createDataFrame([("1", "x")], "NU_REGISTRO string, DS_ASSUNTO string")
    assert [(r.severity, r.rule, r.n) for r in quality.quality_issues(df).collect()] == [("error", "missing_columns", 5)]
    raw = spark.createDataFrame([("1", "2024-01-01"), ("1", "n/a"), ("2", None)], "NU_REGISTRO string, raw string")
    df = raw.withColumn("d", TM.parse_timestamp("raw"))
    got = {(r.rule, r.column): (r.n, r.sample) for r in quality.quality_issues(
        df, ["NU_REGISTRO"], date_col="d", raw_dates="raw").collect()}
    assert got == {("duplicate_key", "NU_REGISTRO"): (1, "1"), ("null_dates", "d"): (2, None),
                   ("unparseable_dates", "d"): (1, None)}
    assert not quality.is_valid(quality.quality_issues(df, ["NU_REGISTRO"], date_col="d"))


def test_mapping_report(spark):
    rows = mapping_report(spark, {"a.csv": ["Data Registro", "unidade", "zzz"]}).collect()
    got = {r.original: (r.target, r.changed) for r in rows}
    assert got["Data Registro"] == ("DT_REGISTRO_ATENDIMENTO", True) and got["unidade"] == ("DS_FILIAL", True)
    assert got["zzz"][1] is False


def test_plans(spark):
    c = fx.complaints(spark, SF)
    b, a = fx.complaints_before(spark, SF), fx.complaints_after(spark, SF)
    j = compare.reclassified_distribution(b, a)
    assert plan(j).count("Join") == plan(b.select(S.KEY).join(a.select(S.KEY, S.SUBCATEGORY), S.KEY)).count("Join")
    t = table(spark, SF, "documents").select("doc_id", "text")
    stats = plan(features.tfidf_vocabulary(t, "text", "doc_id"))
    assert stats.count("Exchange hashpartitioning") == 1
    s = sampling.stratified_sample_a(c, S.CATEGORY, "row_id", total=100)
    assert s.count() > 0
