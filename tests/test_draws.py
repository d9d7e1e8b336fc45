"""Draws that shuffle no texts."""

from pyspark.sql import functions as F

from ombuds.operators import forest, sampling


def test_drawing_shuffles_no_rows_by_label(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).cast("string").alias("g"), F.repeat(F.lit("text "), 50).alias("text"))
    s = sampling.stratified_sample_b(rows, "g", "id", 100)
    assert s.count() == 100
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    for line in plan.splitlines():  # what is shuffled holds no text
        assert "Exchange hashpartitioning" not in line or "text" not in line


def test_forest_draws_before_it_makes_grams(spark, monkeypatch):
    seen = []
    real = forest.stratified_sample_b
    monkeypatch.setattr(forest, "stratified_sample_b", lambda df, *a: seen.append(df.columns) or real(df, *a))
    rows = [(str(i), "uma casa azul" if i % 2 else "um carro vermelho", "AB"[i % 2]) for i in range(40)] + [("x", "casa azul", "OUTROS")]
    t = spark.createDataFrame(rows, "NU_REGISTRO string, DS_OBSERVACAO string, SUB_ASSUNTO string")
    got = forest.forest_predict(t, numTrees=5, maxDepth=3).collect()
    assert [(r.NU_REGISTRO, r.predicted) for r in got] == [("x", "B")] and seen == [["NU_REGISTRO", "_label", "_text"]]
