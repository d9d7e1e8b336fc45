import zlib

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from ombuds.llm import langid, queries, quality_model, quality_rules, topk, toxicity, url_filter
from ombuds.sources.tables import table

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n ", "123 !!", "é", "a", "word " * 3000, "x" * 30_000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(H.rows_of(ODD) + [(None, "no id", "x", 1, "y", 2, None, None)], H.SCHEMA)


@pytest.fixture(scope="module")
def truth(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return {r.doc_id: r for r in docs.select("doc_id", "text", "lang").join(labels, "doc_id", "left").collect()}


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 12345, -3)], "i long")
    assert [r[0] for r in df.select(queries.fold(F.col("i"), 5)).collect()] == \
        [zlib.crc32(str(i).encode()) % 5 for i in (0, 7, 12345, -3)]


def test_toxicity_on_held_out_rows(spark, truth):
    rows = queries.op7_toxicity(spark, SF).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and truth[r.doc_id].toxic is not None]
    good = sum(r.predicted == truth[r.doc_id].toxic for r in held) / len(held)
    assert good >= 0.95
    assert sum(r.predicted for r in held if truth[r.doc_id].toxic) >= 0.6 * sum(truth[r.doc_id].toxic for r in held)
    words = ("idiot", "moron", "stupid", "trash", "scum", "clown", "loser", "pathetic", "worthless", "disgusting")
    clean = [r for r in rows if not any(w in truth[r.doc_id].text.lower() for w in words)]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    bad = [r for r in rows if sum(truth[r.doc_id].text.lower().count(w) for w in words) >= 3]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.arange(1, 20, dtype=np.uint64), np.zeros(19))
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    word = rng.integers(0, 19, (6, toxicity.WINDOW))
    word[2, 5:] = -1
    head, tail = rng.integers(0, 9, (2, 6, toxicity.WINDOW))
    y, w = np.array([0, 1, 0, 1, 1, 0.]), np.ones(6)

    def loss():
        z = net.forward(*net.inputs(word, head, tail))
        p = toxicity.sigmoid(z)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    before = {k: v.copy() for k, v in net.p.items()}
    adam: dict = {}
    net.step(adam, word, head, tail, y, w, 0.0)
    for name in ("q", "w", "uf", "ub", "wf", "bb", "head"):
        at = np.unravel_index(np.abs(adam[name][0]).argmax(), adam[name][0].shape)
        got = adam[name][0][at] * 10  # the first moment after one step is a tenth of the gradient
        sides = []
        for e in (1e-3, -1e-3):
            net.p[name] = before[name].copy()
            net.p[name][at] += e
            sides.append(loss())
        net.p[name] = before[name]
        assert abs((sides[0] - sides[1]) / 2e-3 - got) < 0.05 * abs(got) + 1e-4, name


def test_scores_equal_plain_loops():
    """Every window of every text, word by word."""
    import pyarrow as pa
    from ombuds.llm.words import utf8
    rng = np.random.default_rng(3)
    texts = [" ".join("w%d" % i for i in rng.integers(0, 40, n)) for n in (1, 31, 32, 33, 90)] + [""]
    raw, off = utf8(pa.array(texts))
    t = toxicity.Tokens(raw, off)
    net = toxicity.Network(np.unique(t.hash)[::2], rng.normal(0, 1, len(np.unique(t.hash)[::2])))
    p = {k: v.astype(float) for k, v in net.p.items()}
    word, head, tail = net.ids(t)

    def cell(x, h, u, b, w):
        z = x @ w + b
        a, n = h @ u, len(h)
        g = 1 / (1 + np.exp(-(z[:2 * n] + a[:2 * n])))
        new = np.tanh(z[2 * n:] + g[n:] * a[2 * n:])
        return (1 - g[:n]) * new + g[:n] * h

    want = []
    for d in range(len(texts)):
        rows = list(range(t.first[d], t.first[d + 1]))
        best = []
        for at in range(0, max(1, len(rows) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            xs = [p["word"][word[i]] + p["head"][head[i]] + p["tail"][tail[i]] for i in rows[at:at + toxicity.WINDOW]]
            h = np.zeros(toxicity.HIDDEN)
            forth = [h := cell(x, h, p["uf"], p["bf"], p["wf"]) for x in xs]
            h = np.zeros(toxicity.HIDDEN)
            back = [h := cell(x, h, p["ub"], p["bb"], p["wb"]) for x in xs[::-1]][::-1]
            both = [np.concatenate(x) for x in zip(forth, back)]
            if both:
                e = np.exp([b @ p["q"] for b in both])
                best.append(sum(a * b for a, b in zip(e / e.sum(), both)) @ p["w"] + p["c"][0])
        want.append(max(best, default=p["c"][0]))
    assert np.allclose(net.texts(raw, off)[:-1], want[:-1], atol=1e-4)


def test_training_does_not_depend_on_the_order_of_rows(spark):
    import pyarrow as pa
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = docs.join(queries.labelled(spark, "/root/testdata/sf0.001", "toxic").where("label is not null"), "doc_id").select(
        F.xxhash64("text").alias("key"), "text", "label").toArrow().combine_chunks()
    found = []
    for seed in (None, 1, 2):
        order = np.arange(len(rows)) if seed is None else np.random.default_rng(seed).permutation(len(rows))
        parts = pa.Table.from_batches(toxicity.examples(rows.take(order).to_batches()))
        out = toxicity.fit_part((pa.scalar(0),), parts).to_pylist()[0]
        found.append((out["logit"], out["label"]))
    assert found[0] == found[1] == found[2]


def test_quality_on_held_out_rows(spark, truth):
    rows = queries.op5_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id].quality is not None]
    good = sum(r.predicted == truth[r.doc_id].quality for r in held) / len(held)
    assert good >= 0.93


def test_isotonic():
    rng = np.random.default_rng(1)
    x, w = rng.permutation(60), rng.integers(1, 5, 60).astype(float)
    y = np.sort(rng.random(60))[x] + rng.normal(0, 0.3, 60)
    got = quality_model.isotonic(x, y, w)
    ys, ws = y[np.argsort(x)], w[np.argsort(x)]
    want = [max(min((ys[a:b + 1] * ws[a:b + 1]).sum() / ws[a:b + 1].sum() for b in range(i, 60))
                for a in range(i + 1)) for i in range(60)]
    assert np.allclose(got, want)


def test_language_on_held_out_rows(spark, truth):
    rows = queries.op9_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    good = sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held)
    assert len(rows) == 1000 and good >= 0.97


def test_kneser_ney_sums_to_one():
    import pyarrow as pa
    from ombuds.llm.words import utf8
    key, _ = langid.text_grams(*utf8(pa.array(["the cat sat on the mat", "a hat that the bat had"])))
    m = langid.KneserNey(*np.unique(key, return_counts=True))
    known = m.keys[0]
    for ctx in (m.ctx[3][0], m.ctx[3][5], np.uint64(12345)):
        p = m.at((ctx << langid.BITS) | known, 4).sum()
        assert p < 1 and p + m.back[0][0] / m.size > 0.999


def test_scorers_on_odd_rows(spark, odd):
    docs, labels = table(spark, SF, "documents"), queries.labelled(spark, SF, "toxic")
    net = toxicity.train(docs, labels)
    model = quality_model.train(docs, queries.labelled(spark, SF, "quality"))
    models = langid.train(docs.select("lang", "text"))
    a = odd.select("doc_id", toxicity.score(F.col("text"), net).alias("t"),
                   quality_model.score(F.col("text"), model).alias("q")).collect()
    assert len(a) == len(ODD) + 1 and all(0 <= r.t <= 1 and 0 <= r.q <= 1 for r in a)
    got = {r.doc_id: r for r in langid.identify(odd, models).collect()}
    assert [got[i].lang_pred == "und" for i in range(6)] == [True, True, True, True, False, False]
    none = odd.limit(0)
    assert langid.identify(none, models).count() == 0 and quality_model.stats(none).count() == 0


def test_nothing_to_learn_from(spark, odd):
    none = spark.createDataFrame([], "doc_id long, label int")
    net = toxicity.train(odd, none)
    model = quality_model.train(odd, none)
    assert langid.train(odd.select("lang", "text")) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    rows = odd.select(toxicity.score(F.col("text"), net).alias("t"), quality_model.score(F.col("text"), model).alias("q"))
    assert {(r.t, r.q) for r in rows.collect()} == {(0.0, 0.5)}


def test_line_rules(spark):
    texts = [None, "", "Plain words make a sentence that is kept here, all of it.",
             "Home | About | News | Contact | Help\nA normal sentence of quite some words follows here.",
             "$$$ buy### now*** cheap$$$ %%% words&&& more*** and### more$$$ of%%% it***",
             "\n".join(["Menu", "Top", "This line is long enough to be kept, with its ten words."])]
    rows = {r.doc_id: r for r in quality_rules.clean(spark.createDataFrame(H.rows_of(texts), H.SCHEMA)).collect()}
    assert [rows[i].kept for i in range(6)] == [False, False, True, True, False, True]
    assert rows[3].clean_text == "A normal sentence of quite some words follows here."
    assert rows[5].clean_text.startswith("This line")
    assert rows[0].n_words == 0 and rows[1].word_chars == 0


def test_repeated_windows(spark):
    import random
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = {r.doc_id: r for r in quality_rules.clean(spark.createDataFrame(H.rows_of(texts), H.SCHEMA)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)}
        assert rows[i].n_repeat_words == len(covered), t


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.COM", "https://x.example.com/en/1?q", "http://www.example.com/en/", "ftp://a.net/fr/x#y",
            "http://a.net/es/", "http://bad.org/1", "http://bad.org/2", "http://good.org/"] + ["http://bad.org/x"] * 30
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([(i, int(u is not None and "bad.org" in u)) for i, u in enumerate(urls)], "id long, bad int")
    r = {x.page_id: x for x in url_filter.judge(pages, outcomes).collect()}
    assert len(r) == len(urls)
    assert (r[0].host, r[0].path, r[0].rule) == ("", "", None) and (r[1].host, r[1].path) == ("", "")
    assert (r[2].host, r[2].path, r[2].rule, r[2].verdict) == ("a.example.com", "", None, "allow")
    assert (r[3].rule, r[3].verdict, r[3].path) == ("example.com/en/", "block", "/en/1")
    assert r[4].verdict == "allow" and r[5].rule == "net/fr/" and r[6].rule == "net/es/"
    assert r[7].verdict == "block" and r[7].rule is None and r[9].verdict == "allow"
    none = outcomes.limit(0)
    assert url_filter.judge(pages, none).where("verdict = 'block'").count() == 3
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0


def brute(rows, queries_, k):
    out = []
    for q, v in queries_:
        s = sorted(((-int(v @ u), i) for i, u in rows if i != q))[:k]
        out += [(q, n + 1, i, -m) for n, (m, i) in enumerate(s)]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.2, (900, 16))
    v[100:400] = v[50]  # a large group of copies: ties
    data = [(i, x.tolist(), "x", 1) for i, x in enumerate(v)]
    data += [(900, None, "x", 1), (901, [None] * 16, "x", 1), (902, [float("nan")] * 16, "x", 1),
             (903, [0.0] * 15 + [float("inf")], "x", 1), (904, [1.0], "x", 1), (None, [0.0] * 16, "x", 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string, rank int").repartition(4)
    monkeypatch.setattr(topk, "BLOCK", 64)
    whole = np.floor(v * 256).astype(int)
    rows = list(enumerate(whole))
    want = brute(rows, [r for r in rows if r[0] % 30 == 0], 5)
    got = topk.search(df, lambda i: i % 30 == 0).collect()
    assert sorted(tuple(r) for r in got) == want
    few = topk.search(df.where("vec_id < 3"), lambda i: i >= 0).collect()
    assert sorted(tuple(r) for r in few) == brute(rows[:3], rows[:3], 5)
    assert topk.search(df.limit(0), lambda i: i > 0).count() == 0


def test_topk_tells_rows_of_one_id_apart(spark):
    rng = np.random.default_rng(6)
    ids = [0, 0, 0, 1, 2, 3, 3, None]
    for scale in (0.2, 1e6):  # vectors with exact floats, and large ones
        v = np.round(rng.normal(0, scale, (8, 4)), 2)
        v[6] = v[5]
        df = spark.createDataFrame(list(zip(ids, v.tolist())), "vec_id long, embedding array<double>").repartition(3)
        u = [[int(np.floor(x * 256)) for x in w] for w in v.tolist()]
        want = []
        for q in range(7):
            if ids[q] % 3 == 0:
                s = sorted((-sum(x * y for x, y in zip(u[q], u[j])), ids[j]) for j in range(7) if j != q)[:5]
                want += [(ids[q], n + 1, i, -m) for n, (m, i) in enumerate(s)]
        got = topk.search(df, lambda i: i % 3 == 0).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_topk_of_large_vectors(spark, monkeypatch):
    import math
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.2, (300, 200))
    v[7] *= 1e6                       # an outlier that is no query
    v[30, 3] = 40000.0                # a query
    v[31] = v[30]
    v[40] = 30000.0                   # each component is small, their sum of products passes 2**53
    v[41] = v[40]
    v[41, 0] += 1 / 256
    v[60] = rng.normal(0, 1, 200) * 1e25  # scores beyond a long
    v[61] = rng.normal(0, 1, 200) * 1.5e305
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(topk, "BLOCK", 64)
    whole = [[int(x) * 256 if abs(x) > 2 ** 60 else math.floor(x * 256) for x in u] for u in v.tolist()]
    want = []
    for q in range(0, 300, 10):
        s = sorted((-sum(x * y for x, y in zip(whole[q], u)), i) for i, u in enumerate(whole) if i != q)[:5]
        want += [(q, n + 1, i, max(-2 ** 63, min(2 ** 63 - 1, -m))) for n, (m, i) in enumerate(s)]
    got = topk.search(df, lambda i: i % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == want
    alone = topk.search(df.where("vec_id in (30, 31)"), lambda i: i >= 0).collect()
    assert [tuple(r)[:3] for r in sorted(alone)] == [(30, 1, 31), (31, 1, 30)]


def test_letters_beyond_latin_are_told_apart(spark):
    import pyarrow as pa
    from ombuds.llm.words import utf8
    sym, doc = langid.text_symbols(*utf8(pa.array(["\u9020", "a\U00020000 \U00020001b", "\u1020"])))
    assert sym.tolist() == [32, 0x9020, 32, 97, 0xD840, 0xDC00, 32, 0xD840, 0xDC01, 98, 32, 0x1020]
    assert doc.tolist() == [0] * 2 + [1] * 8 + [2] * 2
    rows = [("zh", "\u9020\u4e20 \u9020\u8020\u9020"), ("my", "\u1020\u1001 \u1020\u1002\u1020"),
            ("ex", "\U00020000\U00020001 \U00020000\U00020020")]
    models = langid.train(spark.createDataFrame(rows * 3, "lang string, text string"))
    asked = ["\u9020\u9020\u9020", "\u1020\u1020", "\U00020000", "\u9020", " \u3000 1"]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"),
                                                models).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["zh", "my", "ex", "zh", "und"]


def test_language_models_keep_all_grams(spark, monkeypatch):
    import pyarrow as pa
    from ombuds.llm.words import utf8
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    texts = {"aa": "".join(rng.choice(letters, 400_000)), "bb": "the cat sat on the mat and the bat had a hat " * 3}
    models = langid.train(spark.createDataFrame(list(texts.items()), "lang string, text string"))
    plain = []
    for t in texts.values():
        key, _ = langid.text_grams(*utf8(pa.array([t])))
        plain.append(langid.KneserNey(*np.unique(key, return_counts=True)))
    assert len(plain[0].keys[-1]) > 250_000  # the most that were kept before
    asked = ["the cat sat", "qzxj vkwq", "\u00e9\u00df new letters", "ab", "\u00e9", texts["aa"][:5000]]
    rows = spark.createDataFrame(list(enumerate(asked)), "tag long, text string").repartition(2)
    want = {}
    for i, t in enumerate(asked):
        sym, _ = langid.text_symbols(*utf8(pa.array([t])))
        key, _ = langid.text_grams(*utf8(pa.array([t])))
        want[i] = [np.log(m.at(key, 4) if len(key) else m.at(sym, 1)).sum() for m in plain]
    for size in (langid.RANGE_BYTES, 2000):  # in one key range and in several
        monkeypatch.setattr(langid, "RANGE_BYTES", size)
        got = {r.tag: r for r in models.sums(rows).collect()}
        assert len(got) == len(asked) and all(r.letters for r in got.values())
        for i in want:
            assert np.allclose(got[i].total, want[i], rtol=1e-5), (i, got[i].total, want[i])
