import zlib

import corpus_pipeline
import helpers as H
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ombuds.llm import queries
from ombuds.session import shared_dir
from ombuds.sources.tables import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before the first stage and after each."""
    docs = table(spark, SF, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, f"test-{name}") + "/t"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_classifiers_reject(spark, stages):
    tox = {r.doc_id for r in queries.op7_toxicity(spark, SF).collect() if r.predicted}
    good = {r.doc_id for r in queries.op5_quality_classifier(spark, SF).collect() if r.predicted}
    kept = [i for i in ids(stages["documents"]) if i not in tox]
    assert tox and ids(stages["toxicity"]) == kept
    assert ids(stages["quality"]) == [i for i in kept if i in good]


def test_one_of_each_class(stages):
    docs = sorted((r.doc_id, r.text) for r in stages["quality"].collect())
    assert ids(stages["near_dedup"]) == [i for i, root in H.classes(docs).items() if i == root]


def test_passages_removed(stages):
    docs = [(r.doc_id, r.text) for r in stages["near_dedup"].collect()]
    want = H.removed_by_windows(docs)
    text = dict(docs)
    out = stages["substring_dedup"].collect()
    assert len(out) == len(docs)
    for r in out:
        words, gone = want[r.doc_id]
        assert r.text == (" ".join(w for w, g in zip(words, gone) if not g) if any(gone) else text[r.doc_id])
        assert r.n_chars == len(r.text)
    for name in ("toxicity", "quality", "near_dedup", "substring_dedup"):
        assert stages[name].columns == stages["documents"].columns


def test_packed(stages):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {}
    for r in stages["packing"].orderBy("start").collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    docs = {r.doc_id: r.text for r in stages["substring_dedup"].collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in docs.items()}


def test_run(spark, stages):
    a = corpus_pipeline.run(spark, SF).agg(F.count("*"), F.sum("length")).first()
    assert tuple(a) == tuple(stages["packing"].agg(F.count("*"), F.sum("length")).first())


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if "text" in out.columns and "ids" not in out.columns else docs
