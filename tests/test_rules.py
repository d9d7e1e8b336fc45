"""Hand-made rows for the rules the test tables do not reach (FIXTURES.md §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from ombuds import schema as S
from ombuds.functions import temporal as TM
from ombuds.functions import text as X
from ombuds.operators import compare, kpi, knn, sampling
from ombuds.operators.dedupe import keep_first
from ombuds.sources.columns import map_columns, plan_mapping, token_sort_ratio

VALUES = [None, "", "  ", " outro ", "OUTROS (DETALHAR)", "X"]


def _flags(spark, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_needs_category(spark):
    assert _flags(spark, X.needs_category) == [True, True, True, True, False, False]


def test_needs_subcategory(spark):
    assert _flags(spark, X.needs_subcategory) == [True, True, True, True, True, False]


def test_has_outro(spark):
    assert _flags(spark, X.has_outro) == [False, False, False, True, True, False]


def test_chart_filter_keeps_padded_outros(spark):
    df = spark.createDataFrame([(" Outros ",)], "v string")
    assert df.where(X.keep_specific_category("v")).count() == 1
    assert df.where(X.keep_specific_subcategory("v")).count() == 0
    assert df.select(X.needs_category("v")).first()[0] is True


def test_composite_text(spark):
    long_text = "a" * 2100
    df = spark.createDataFrame([(" abcde ", "abcdef", long_text)],
                               "DS_OBSERVACAO string, DS_MOTIVO string, DS_RETORNO string")
    out = df.select(X.composite_text(df.columns).alias("t")).first()["t"]
    assert out.startswith("abcdef ")
    assert len(out) == 2000


def test_week_and_label(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 29),), (dt.datetime(2024, 12, 30),)], "ts timestamp_ntz")
    rows = df.select(TM.week_start("ts").alias("w"), TM.week_label("ts").alias("l")).collect()
    assert [r.w for r in rows] == [dt.date(2024, 12, 23), dt.date(2024, 12, 30)]
    assert rows[1].l == "30/12-05/01"


def test_date_filter_end_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 10),)], [S.REGISTERED_AT]).select(
        F.col(S.REGISTERED_AT).cast("timestamp_ntz").alias(S.REGISTERED_AT))
    assert kpi.date_filter(df, dt.date(2024, 1, 1), dt.date(2024, 1, 31)).count() == 0
    assert kpi.date_filter(df, dt.date(2024, 1, 1), dt.date(2024, 1, 31), end_inclusive="day").count() == 1


def test_period_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23),), (dt.datetime(2024, 1, 3, 1),)],
                               "DT_REGISTRO_ATENDIMENTO timestamp_ntz")
    df = df.withColumns({S.CATEGORY: F.lit("a"), S.BRANCH: F.lit("b")})
    assert kpi.kpi_row(df).first()["period_days"] == 1


def _topk(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, ref_id int, ref_label string, similarity double")


def test_vote_sum_wins_mean_decides(spark):
    top = _topk(spark, [(1, 1, 10, "A", 0.9), (1, 2, 11, "B", 0.5), (1, 3, 12, "B", 0.5),
                        (1, 4, 13, "C", 0.2), (1, 5, 14, "B", 0.1)])
    r = knn.vote(top, 0.45).first()
    assert r.predicted == "B"
    assert r.score == pytest.approx(1.1)
    assert r.confidence == pytest.approx(0.366667, abs=1e-6)
    assert r.accepted is False and r.method == "manual_review"


def test_vote_tie_goes_to_nearer(spark):
    top = _topk(spark, [(1, 1, 10, "A", 0.6), (1, 2, 11, "B", 0.6)])
    assert knn.vote(top, 0.45).first().predicted == "A"


def test_nearest_mode_writes_below_threshold(spark):
    top = _topk(spark, [(1, 1, 10, "A", 0.1)])
    r = knn.nearest(top, 0.45).first()
    assert r.predicted == "A" and r.accepted is False


def test_zero_vector_similarity(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id int, vec array<double>")
    r = spark.createDataFrame([(7, [1.0, 0.0], "A")], "ref_id int, vec array<double>, label string")
    out = knn.similarity_topk(q, r, k=1).first()
    assert out.similarity == 0.0 and out.ref_id == 7


def test_column_mapping_exact_aliases():
    cols = ["Data Registro", "unidade", "categoria"]
    mapped = {c: t for c, t, _ in plan_mapping(cols)}
    assert mapped == {"Data Registro": S.REGISTERED_AT, "unidade": S.BRANCH, "categoria": S.CATEGORY}


def test_column_mapping_keeps_category_without_sub():
    cols = [c for c in S.REQUIRED_COLUMNS if c != S.SUBCATEGORY]
    mapped = {c: t for c, t, _ in plan_mapping(cols)}
    assert mapped[S.CATEGORY] == S.CATEGORY


def test_column_mapping_id_beside_key(spark):
    cols = ["id", S.KEY]
    mapped = {c: t for c, t, _ in plan_mapping(cols)}
    assert mapped[S.KEY] == S.KEY and mapped["id"] is None
    df = spark.createDataFrame([(1, "a")], "id int, NU_REGISTRO string")
    assert map_columns(df).columns == ["id", S.KEY]


def test_token_sort_ratio():
    assert token_sort_ratio("registro data", "data registro") == 100.0
    assert round(token_sort_ratio("ds assunto", "sub assunto"), 1) == 85.7


def test_dedupe_null_keys(spark):
    df = spark.createDataFrame([(None, 0, 1, "first"), (None, 0, 2, "second"), ("k", 1, 3, "x")],
                               "NU_REGISTRO string, source_ord int, row_id int, v string")
    out = {r.NU_REGISTRO: r.v for r in keep_first(df, S.KEY, ["source_ord", "row_id"]).collect()}
    assert out == {None: "first", "k": "x"}


def test_growth_before_zero(spark):
    before = spark.createDataFrame([("outros",)], "SUB_ASSUNTO string")
    after = spark.createDataFrame([("A",), ("A",), ("A",)], "SUB_ASSUNTO string")
    r = compare.before_after(before, after).first()
    assert r.label == "A" and r.before == 0 and r.after == 3 and r.growth_pct is None and r.is_new


def test_stratified_a_sizes(spark):
    rows = [(i, "a") for i in range(9000)] + [(9000 + i, "b") for i in range(980)] + \
           [(10000 + i, "c") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = {r.label: r["count"] for r in sampling.stratified_sample_a(df, "label", "id").groupBy("label").count().collect()}
    assert got == {"a": 4500, "b": 490, "c": 10}
