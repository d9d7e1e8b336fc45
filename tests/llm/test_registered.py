"""The registered queries themselves, digests and casts included, against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import helpers as H
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from ombuds.llm import queries, quality_model
from ombuds.sources.tables import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_packing_digests(spark, docs):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for i, x in docs.items()}
    at, fill = Counter(), {}
    for r in queries.op1_packing(spark, SF).orderBy("doc_id", "start").collect():
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for pieces in fill.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0


def test_near_duplicate_classes(spark, docs):
    got = {r.doc_id: r.class_id for r in queries.op2_probminhash(spark, SF).collect()}
    assert got == H.classes(sorted(docs.items()))


def test_passage_digests(spark, docs):
    want = H.removed_by_windows(docs.items())
    rows = queries.op3_fm_index(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words, gone = want[r.doc_id]
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), sum(gone), sha(kept.encode()))


def test_bpe_digests(spark, docs):
    enc = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")),
                            special_tokens={})
    rows = queries.op6_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(docs[r.doc_id].encode())


def test_topk_scores(spark):
    rows = [(r[0], r[1]) for r in table(spark, SF, "embeddings").select("vec_id", F.col("embedding")).collect()]
    rows = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in rows:
        if i % 50 == 0:
            best = sorted(((-int(v @ w), j) for j, w in rows if j != i))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op10_pivot_topk(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def plain_statistics(text: str) -> list[float]:
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    if not words:
        return [0.0] * 16

    def again(values):
        return 1 - len(set(values)) / len(values) if values else 0.0

    def count(chars):
        return sum(b in chars for b in raw)

    n, size = len(words), [len(w) for w in words]
    mean, ink = sum(size) / n, sum(size)
    sd = math.sqrt(sum((s - mean) ** 2 for s in size) / n)
    upper, lower, high = count(range(65, 91)), count(range(97, 123)), count(range(128, 256))
    fives = [tuple(words[i:i + 5]) for i in range(n - 4)]
    return [math.log1p(n), math.log1p(mean), math.log1p(sd), math.sqrt(count(b"#*$%&<>") / ink), math.sqrt(count(b"|") / n),
            upper / max(1, upper + lower + high), count(b"0123456789") / ink, math.sqrt(count(b"!?") / n),
            count(b".,;:") / n, count(b"\n") / n, high / ink, again(words), max(Counter(words).values()) / n,
            math.sqrt(again(fives)), math.sqrt(again(lines)), math.log1p(n / max(1, len(lines)))]


def test_quality_equals_plain_normal_equations(spark, docs):
    """Statistics by plain loops, one matrix of all rows, the ridge solved whole, calibration as a step function."""
    x = {i: np.array(plain_statistics(t)) for i, t in docs.items()}
    known = quality_model.stats(table(spark, SF, "documents"))
    for r in known.collect():
        assert np.allclose(r.x, x[r.id], atol=1e-6), r.id
    labels = queries.labelled(spark, SF, "quality")
    rows = labels.where("label IN (0, 1)").select("doc_id", "label", (F.xxhash64("doc_id") % 2 == 0).alias("half")).collect()
    rows = [r for r in rows if r.doc_id in x]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    a = np.stack([x[r.doc_id] for r in rows])
    y, half = np.array([r.label for r in rows], float), np.array([r.half for r in rows])
    plain = quality_model.Model(a.mean(0), a.std(0))
    f = plain.features(a)
    ridge = quality_model.RIDGE * np.eye(f.shape[1])
    ridge[-1, -1] = 1e-6
    for k, use in enumerate((half | ~half, ~half, half)):
        plain.weights[k] = np.linalg.solve(f[use].T @ f[use] + ridge, f[use].T @ y[use])
    left = np.where(half, plain.raw(a, 1), plain.raw(a, 2))
    bins = np.floor((left + 1) * quality_model.BINS / 3)
    names = np.unique(bins)
    level = quality_model.isotonic(names, np.array([y[bins == b].mean() for b in names]),
                                   np.array([(bins == b).sum() for b in names], float))
    plain.x, plain.y = (names + 0.5) * 3 / quality_model.BINS - 1, np.clip(level, 0, 1)
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, SF).collect()}
    want = dict(zip(x, plain.score(np.stack(list(x.values())))))
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert abs(r.score - want[i]) < 1e-4 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
