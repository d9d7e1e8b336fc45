"""Text features against plain Python."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from ombuds.operators import features

TEXTS = [None, "", " - ", "a", "Uma CASA azul, uma casa AZUL.", "casa azul", "x1 _y é éa ÉA", "a b c dd", "\U00020000\U00020001 zz",
         "casa", "uma casa azul uma"]


def plain_tokens(t):
    return re.findall(r"\w{2,}", t.lower()) if t else []


def plain_grams(t):
    w = plain_tokens(t)
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[5]), (None, TEXTS[4]), (None, TEXTS[9])]  # ids repeated and null
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.mark.parametrize("rows_at_once, sent", [(4096, 100_000), (2, 1)])
def test_vocabulary_and_vectors_equal_plain_counts(spark, docs, monkeypatch, rows_at_once, sent):
    monkeypatch.setattr(features, "PIECE_ROWS", rows_at_once)
    monkeypatch.setattr(features, "SENT_TERMS", sent)
    rows, df = docs
    tf, held = collections.Counter(), collections.Counter()
    for _, t in rows:
        tf.update(plain_grams(t))
        held.update(set(plain_grams(t)))
    kept = {t: (held[t], tf[t]) for t in tf if 2 <= held[t] <= 0.95 * len(rows)}
    voc = features.tfidf_vocabulary(df, "text", "id", max_features=None)
    got = {r.term: (r.df, r.tf) for r in voc.collect()}
    assert got == kept and "uma casa azul" in got
    by_id = collections.defaultdict(collections.Counter)
    for i, t in rows:
        by_id[i].update(g for g in plain_grams(t) if g in kept)
    want = {}
    for i, c in by_id.items():
        w = {t: n * (math.log((1 + len(rows)) / (1 + held[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, t): round(x / length, 9) for t, x in w.items()})
    assert {(r.id, r.term): round(r.weight, 9) for r in features.tfidf_vectors(df, "text", "id", voc).collect()} == want


def test_grams_of_a_term_are_one_row_a_piece():
    texts = pa.array(["aa bb aa bb"] * 50 + [None, "", "aa"])
    out = {t: (n, d) for term, _, tf, df in features.gram_counts(texts, 3, by_row=False)
           for t, n, d in zip(term.to_pylist(), tf.to_pylist(), df.to_pylist())}
    assert out == {"aa": (101, 51), "bb": (100, 50), "aa bb": (100, 50), "bb aa": (50, 50), "aa bb aa": (50, 50), "bb aa bb": (50, 50)}


@pytest.mark.parametrize("rows_at_once", [4096, 2])
def test_md5_encoder_equals_plain_buckets(spark, docs, monkeypatch, rows_at_once):
    monkeypatch.setattr(features, "PIECE_ROWS", rows_at_once)
    rows, df = docs
    dims = 16
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims
    held = collections.Counter(b for _, t in rows for b in {bucket(w) for w in plain_tokens(t)})
    idf = np.array([math.log((len(rows) + 1) / (held[b] + 1)) for b in range(dims)])
    fitted = features.Md5Encoder(dims).fit(df, "text")
    assert np.allclose(fitted.idf, idf)
    for r in fitted.encode(df, "text").collect():
        if r.text is None:
            assert r.vec is None
        else:
            v = np.bincount([bucket(w) for w in plain_tokens(r.text)], minlength=dims) * idf
            assert np.allclose(r.vec, v / (np.linalg.norm(v) or 1))
    assert not hasattr(features, "md5_buckets")  # no md5 of each single token
