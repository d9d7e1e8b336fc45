"""op9's calibration is measured on all distinct training texts (F1)."""

import numpy as np
from pyspark.sql import functions as F

from ombuds.llm import langid


def rows_of(n):
    rng = np.random.default_rng(3)
    words = ["sol", "mar", "casa", "rua", "ave", "luz", "noite", "dia"]
    return [(i, " ".join(rng.choice(words, 1 + i % 9)), "pt" if i % 3 else "xx") for i in range(n)] + [(n, "so lo", None), (n + 1, None, "pt")]


def test_all_distinct_texts_calibrate(spark):
    rows = rows_of(5000)  # more distinct texts than the 2,000 that were drawn before
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    twice = df.unionAll(df.where("doc_id < 5"))  # a copy counts once
    models = langid.train(twice.select("lang", "text"))
    t = models.sums(df.where("lang is not null and text is not null").select(F.col("doc_id").alias("tag"), "text")).collect()
    of = {i: (x, lang) for i, x, lang in rows}
    for k, name in enumerate(models.langs):
        own = {of[r.tag][0]: -r.total[k] / r.grams for r in t if of[r.tag][1] == name}
        h = np.array(list(own.values()))
        assert len(h) > 1000
        assert abs(models.mean[k] - np.median(h)) < 1e-9
        assert abs(models.sd[k] - max(0.05, 1.4826 * np.median(np.abs(h - np.median(h))))) < 1e-9


def test_one_pass_equals_two(spark):
    rows = rows_of(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = F.col("doc_id") % 4 != 0
    one = {r.doc_id: tuple(r) for r in langid.learn_and_identify(df, learn).collect()}
    models = langid.train(df.where(learn).select("lang", "text"))
    two = {r.doc_id: tuple(r) for r in langid.identify(df, models).collect()}
    assert one == two and len(one) == len(rows)
    none = langid.learn_and_identify(df, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_medians(spark):
    rng = np.random.default_rng(1)
    groups = [rng.random(n) * 3 for n in (1, 2, 5, 0, 301, 1000)] + [np.repeat([1.0, 2.0], 4)]
    rows = [(g, float(x)) for g, v in enumerate(groups) for x in v]
    got, n = langid.medians(spark.createDataFrame(rows, "own int, v double"), len(groups))
    assert n.tolist() == [len(v) for v in groups]
    assert np.allclose(got, [np.median(v) if len(v) else 0 for v in groups], atol=1e-11, rtol=0)
