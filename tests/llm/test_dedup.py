import random

import helpers as H
import numpy as np
import pytest

from ombuds.llm import graph, minhash, substring
from ombuds.llm.words import Words, utf8

import pyarrow as pa


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 150))] for _ in range(12)]
    texts = [None, "", "  \n ", "one", "one", "two words", "two words"]
    for b in base:
        texts.append(" ".join(b))
        for edits in (0, 1, 2, 4, 12):  # exact and near copies, and some beyond the threshold
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = f"e{rng.random():.6f}"
            texts.append("\n".join(c) if edits == 0 else " ".join(c))
    hot = [rng.choice(vocab) for _ in range(80)]
    for i in range(120):  # a large group of near copies of near copies
        c = list(hot)
        for _ in range(rng.randint(1, 3)):
            c[rng.randrange(80)] = f"h{i}{rng.random():.5f}"
        texts.append(" ".join(c))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for i in range(40):
        texts.append(" ".join(rng.choice(vocab) for _ in range(50)) + "\n" + passage + " " + f"tail{i} " * 3)
    texts += ["a " * 100, "a " * 101, "x y " * 40, " ".join(["x y"] * 40 + ["z"])]
    rng.shuffle(texts)
    return list(enumerate(texts))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, None, None) for i, t in DOCS], H.SCHEMA).repartition(5)


def test_classes_equal_all_pairs(docs):
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == H.classes(DOCS)


def test_one_of_each_class_with_all_columns(docs):
    want = {i for i, r in H.classes(DOCS).items() if i == r}
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)
    text = dict(DOCS)
    assert all(r.text == text[r.doc_id] and r.score == "x" and r.root == 2 for r in rows)


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (8, "other words here")], "doc_id long, text string")
    assert minhash.keep_one(df).count() == 2
    assert minhash.classes(df).count() == 4
    out = substring.remove(spark.createDataFrame([(7, "w " * 30), (7, "w " * 30)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in out) == [29, 30]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(none).count() == 0 and minhash.keep_one(none).count() == 0
    assert substring.remove(none).count() == 0 and substring.cleaned(none).count() == 0


def test_signatures_estimate_the_similarity():
    rng = random.Random(1)
    a = [f"w{rng.randrange(50)}" for _ in range(400)]
    for edits in (2, 10, 40):
        b = list(a)
        for _ in range(edits):
            b[rng.randrange(400)] = f"e{rng.random()}"
        raw, off = utf8(pa.array([" ".join(a), " ".join(b)]))
        w = Words(raw, off)
        sig = minhash.signatures(*minhash.shingles(w, w.hashes()), 2)
        x, y = minhash.bag(raw, off)
        true = H.probability_jaccard(H.bag(" ".join(a)), H.bag(" ".join(b)))
        assert abs(minhash.similarity(x, y) - true) < 1e-9
        assert abs((sig[0] == sig[1]).mean() - true) < 0.13


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    assert got == {i: root(i) for i in parent}


def check_removal(rows, docs):
    want = H.removed_by_windows(docs)
    for r in rows:
        words, gone = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(words), sum(gone)), r.doc_id
        assert r.kept == " ".join(w for w, g in zip(words, gone) if not g)


def test_removal_equals_brute_force(docs):
    check_removal(substring.remove(docs).collect(), DOCS)


def test_removal_with_frequent_seeds(docs, monkeypatch):
    monkeypatch.setattr(substring, "FREQUENT", 3)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(substring)  # so that the workers see the lower limits
    try:
        check_removal(substring.remove(docs).collect(), DOCS)
    finally:
        cloudpickle.unregister_pickle_by_value(substring)


def test_cleaned_keeps_columns_and_untouched_texts(docs):
    out = substring.cleaned(docs)
    assert out.columns == docs.columns and out.schema["n_words"].dataType == docs.schema["n_words"].dataType
    want = H.removed_by_windows(DOCS)
    text = dict(DOCS)
    for r in out.collect():
        words, gone = want[r.doc_id]
        assert r.text == (" ".join(w for w, g in zip(words, gone) if not g) if any(gone) else text[r.doc_id])


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 4, 300), [0], rng.integers(1, 4, 200), [0]])
    fm = substring.FMIndex(text, 20)
    for at in range(0, 280):
        size = int(rng.integers(1, 20))
        part = text[at:at + size]
        low, high = np.array([0]), np.array([len(text)])
        for s in part[::-1]:
            low, high = fm.extend(np.array([s]), low, high)
        hits = [i for i in range(len(text) - size + 1) if (text[i:i + size] == part).all()]
        assert high[0] - low[0] == len(hits)
        assert sorted(fm.suffix[low[0]:high[0]]) == hits
