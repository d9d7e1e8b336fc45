import base64
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ombuds.llm import bpe, packing, queries

BPE = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
WORD = P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "It's  a   test,\n\n don't — 12345 straße Été! ",
         "a b c d\x1ce\u0085f 　g", "<|endoftext|> x<|startoftext|>",
         "word " * 60_000, "x" * 250_000, "\n" * 5_000 + "end" + " " * 5_000, "é ΣΑΣ ẞ İ",
         ("lorem ipsum, dolor\t" * 9_000) + " " * 3_000 + "\tz", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, ids long, n_tokens string")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE[0], "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs):
    enc = library()
    rows = bpe.encode(docs, *BPE).withColumn("raw", bpe.decode(F.col("ids"), *BPE)).collect()
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(text), r.doc_id
        assert bytes(r.raw) == text.encode()


def test_bpe_runs_of_white_space_beyond_the_library():
    enc = library()
    for run in (" ", "\n"):
        ids = bpe.encode_text(enc, "ab" + run * 1_000_000 + "c")
        assert enc.decode(ids) == "ab" + run * 1_000_000 + "c"
        short = enc.encode_ordinary("ab" + run * 50_000 + "c")
        assert bpe.encode_text(enc, "ab" + run * 50_000 + "c") == short


def test_registered_bpe_has_one_python_worker_a_task(spark, docs, tmp_path):
    """Each Python step of the plan would hold a worker, and its ranks and batches, beside the others."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op6_byte_bpe(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)) == 1
    enc = library()
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest(), r.doc_id


def test_bpe_memory_does_not_grow_with_the_input_batch():
    """Results leave in small batches, in order: the peak is that of a slice, not of the 10,000 rows."""
    texts = [None, ""] + [f"row {i} " + "lorem ipsum dolor " * 100 for i in range(9_997)] + ["x y " * 500_000]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    enc, most, at = library(), 0, 0
    enc.encode_ordinary("warm")
    del texts
    tracemalloc.start()
    for part in bpe.encoded([batch], enc, ["id"], "text", "ids", "raw", "decoded"):
        assert part.column("id").to_pylist() == list(range(at, at + part.num_rows))
        at += part.num_rows
        for k in {0, part.num_rows - 1}:
            text = batch.column("text")[at - part.num_rows + k].as_py() or ""
            raw, decoded = part.column("raw")[k].as_py(), part.column("decoded")[k].as_py()
            assert part.column("ids")[k].as_py() == np.frombuffer(raw, "<u4").tolist() and decoded == text.encode()
        if at < 9_000:
            most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert at == batch.num_rows and most < 24e6, most


def test_bpe_extra_columns_replace_their_names(docs):
    got = bpe.encode(docs, *BPE, raw="N_TOKENS", decoded="back", drop_text=True)
    assert got.columns == ["doc_id", "ids", "N_TOKENS", "back"]
    assert all(bytes(r.back) == (TEXTS[r.doc_id] or "").encode() and len(r.N_TOKENS) == 4 * len(r.ids) for r in got.collect())


def test_bpe_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, *BPE, raw="raw", decoded="decoded").count() == 0


def test_packing_places_every_id_once_without_padding(spark, docs):
    rows = packing.pack(docs.repartition(3), WORD).collect()
    t = Tokenizer.from_file(WORD)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(TEXTS):
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        got = np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist()
        assert got == want, i
        assert all(r.doc_tokens == len(want) for r in parts)
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        fill = sum(r.length for r in parts)
        assert fill <= 2048 and fill & (fill - 1) == 0
    assert F.crc32 and zlib.crc32(b"") == 0


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    p = packing.SumOfSquares(64)
    for i in range(3000):
        size = int(rng.integers(1, 65))
        level = p.level_for(size)

        def after(h):
            n = p.count.copy()
            if h:
                n[h] -= 1
            if h + size < 64:
                n[h + size] += 1
            return int((n[1:64] ** 2).sum())

        can = [0] + [h for h in range(1, 65 - size) if p.count[h]]
        assert level in can and after(level) == min(map(after, can))
        p.place((i, 0, b"\0\0\0\0" * size, size), size)


def test_windows_of_one_size_do_not_stay_open():
    """Documents of one size above half a window, and of many sizes: few windows stay open, no id is lost."""
    rng = np.random.default_rng(3)
    for sizes in (np.full(5000, 1500), rng.integers(1, 2049, 5000), rng.choice([700, 1100, 1900], 5000)):
        p, ids = packing.SumOfSquares(2048), 0
        for i, size in enumerate(sizes.tolist()):
            for full in p.put((i, 0, b"\0\0\0\0" * size, size)):
                assert sum(map(packing.size_of, full)) == 2048
                ids += 2048
        held = [w for ws in p.open.values() for w in ws]
        assert len(held) == p.count.sum() < 500
        assert ids + sum(packing.size_of(x) for w in held for x in w) == sizes.sum()


def test_packing_forgets_words_and_goes_on(monkeypatch):
    texts = [" ".join(f"w{i * 7 + j % 11}x" for j in range(40)).encode() for i in range(300)]
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    t = Tokenizer.from_file(WORD)
    packing.word_ids.cache_clear()
    got = list(packing.encode_docs(texts, WORD, 8))
    packing.word_ids.cache_clear()
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text.decode(), add_special_tokens=False).ids


def test_word_ids_equal_the_tokenizer():
    rng = np.random.default_rng(9)
    t = Tokenizer.from_file(WORD)
    chars = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x250), 0x301, 0x3A3, 0x4E2D, 0x1F600, 0x1C, 0xFB01]]
    words = ["".join(rng.choice(chars, int(rng.integers(1, 9)))) for _ in range(6000)]
    words += ["don't", "we'LL", "İstanbul", "ﬁne", "STRASSE", "x'sy", "'s", "a1b22", "<|endoftext|>", "é", "é"]
    memory = packing.WordIds(WORD)
    keys = [w.encode() for w in words if len(w.encode().split()) == 1 and w.encode().split()[0] == w.encode()]
    memory.learn(keys)
    for k in keys:
        want = t.encode(k.decode(), add_special_tokens=False).ids
        assert np.frombuffer(memory[k], "<u4").tolist() == want, k
