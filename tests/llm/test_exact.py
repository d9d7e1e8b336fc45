"""Exact duplicates, spelling variants and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import helpers as H
import numpy as np
import pyarrow as pa
import pytest

from ombuds.llm import divergence, exact_dedup, marks, oracle, spelling
from ombuds.llm.words import utf8

COLUMNS = "doc_id long, text string, lang string, source string, size int, sha string, n int, word string, alive int"


def frame(spark, rows, parts=4):
    """Rows (doc_id, text, lang, source) with further columns whose names the operators use."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], COLUMNS).repartition(parts)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_marks_never_miss(spark):
    keys = spark.range(0, 4000, 7).selectExpr("id * id - 900000 AS k")
    found = marks.marks(keys, keys.k, 1 << 20)
    rows = spark.range(-1000, 1000).selectExpr("id AS k").unionAll(keys)
    out = marks.flagged(rows, rows.k, found, 1 << 20, "hit")
    slots = {r.k % (1 << 20) for r in keys.collect()}
    assert out.columns == ["k", "hit"] and all(r.hit == (r.k % (1 << 20) in slots) for r in out.collect())
    assert all(not r.hit for r in marks.flagged(rows, rows.k, found.limit(0), 1 << 20, "hit").collect())


def exact_rows():
    rng = random.Random(4)
    texts = [None, "", "", "a", "A", "É", "é", "ab", "ba", "x" * 200_000, "X" * 200_000, "x" * 199_999 + "y"]
    head = "same first characters of many texts, longer than the prefix that is hashed first "
    texts += [head + str(rng.randrange(30)) for _ in range(60)]
    texts += [("Hot " if rng.random() < 0.5 else "hOT ") + "group"] * 100 + ["unique %d" % 10 ** i for i in range(12)]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3]), (None, "hot group"), (None, "nobody else"), (None, "alone é")]


def check_exact(got, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    assert len(got) == len(rows)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        seen = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and not seen
            seen |= kept
            want[(i, keep, len(ids), kept, sha)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_exact_classes_equal_brute_force(spark, monkeypatch):
    rows = exact_rows()
    df = frame(spark, [(i, t, "l", "s") for i, t in rows])
    check_exact(exact_dedup.classes(df, digests=True).collect(), rows)
    monkeypatch.setattr(exact_dedup, "HOT", 4)  # the hot group alone is broadcast
    check_exact(exact_dedup.classes(df, digests=True).collect(), rows)
    few = exact_dedup.classes(df).collect()
    assert {r.text_sha256 is None for r in few if r.group_size > 1} == {False}
    assert any(r.text_sha256 is None for r in few)
    assert exact_dedup.classes(df.limit(0)).count() == 0


def test_exact_reads_in_full_only_what_survives(spark):
    rows = [(i, "a" * (i + 1), "l", "s") for i in range(50)] + [(60, "b" * 5, "l", "s"), (61, "A" * 7, "l", "s")]
    alive = {r.id for r in exact_dedup.survivors(frame(spark, rows)).where("alive").collect()}
    assert alive == {6, 61}  # one length has two prefixes, one has the same twice


def test_exact_equals_sql(spark):
    rows = [(i, t) for i, t in exact_rows() if i is not None][:-1]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    got = exact_dedup.classes(frame(spark, [(i, t, "l", "s") for i, t in rows]), digests=True)
    want = con.sql(oracle.EXACT_DEDUP).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


# ---------------------------------------------------------------- spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_of(n):
    links = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 5 * n[w] else None for w, v in links.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(links[w]), n[form[w]] if form[w] else -1) for w in n)


def as_tuples(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def spelling_rows():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 11))) for _ in range(40)] + ["ßöðÿþæ×÷", "aaaaaa", "aaaaaaa"]
    words = list(base)
    for w in base:
        for _ in range(8):
            i, c = rng.randrange(len(w)), rng.choice("abcdeéZ")
            words.append(rng.choice([w[:i] + c + w[i + 1:], w[:i] + w[i + 1:], w[:i] + c + w[i:], w + c, c + w]))
    weight = [rng.choice([1, 1, 2, 9, 60, 400]) for _ in words]
    rows = [(i, " ".join(rng.choice([w, w.upper() if w.isascii() else w]) + rng.choice(["", ",", "1", "ñ!"])
                         for w in rng.choices(words, weight, k=60))) for i in range(300)]
    return rows + [(None, "aaaaaa " * 9), (None, None), (5, ""), (6, "x" * 70_000 + " 東京 ĀāŁ"), (7, "Ab"), (7, "Ab")]


def test_joined_checksums():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice([0, 1, 5, 40, 900]))) for _ in range(200)]
    got = spelling.joined_crc(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32),
                              np.array([zlib.crc32(b) for _, b in pairs], np.uint32), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_vocabulary_equals_brute_force(spark):
    rows = spelling_rows()
    df = frame(spark, [(i, t, "l", "s") for i, t in rows])
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == counted(rows)
    assert spelling.vocabulary(df.limit(0)).count() == 0


def test_variants_equal_brute_force(spark):
    rows = spelling_rows()
    n = counted(rows)
    got = as_tuples(spelling.variants(spelling.vocabulary(frame(spark, [(i, t, "l", "s") for i, t in rows]))))
    want = variants_of(n)
    assert got == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(not w[1] for w in want)  # chains, and words without a form


@pytest.mark.parametrize("size", [8, 64])
def test_large_sets_are_cut_into_blocks(spark, size, monkeypatch):
    rng = random.Random(size)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(300)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) + "ending" for _ in range(200)} | {"aab", "aabb", "a"}
    n = {w: rng.randint(5, 4000) for w in words}
    monkeypatch.setattr(spelling, "BLOCK", size)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_tuples(spelling.variants(df)) == variants_of(n)
    assert spelling.variants(df.limit(0)).count() == 0


# ---------------------------------------------------------------- source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_of(rows, least=30):
    rows = [(t or "", l or "", s or "") for _, t, l, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, n = Counter(), defaultdict(Counter)
        for t, l, s in rows:
            if l == lang:
                terms = TERM.findall(fold(t))
                docs.update(set(terms))
                n[s].update(terms)
        kept = sorted(w for w, c in docs.items() if c >= least)
        v = len(kept)

        def p(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10 ** 9 * (count[w] + 5) // (total + 5 * v) for w in kept}

        q = p(sum(n.values(), Counter()))
        ps = {s: p(c) for s, c in n.items()}
        for s in n:
            pair = [(sum(abs(ps[s][w] - ps[o][w]) for w in kept), o) for o in n if o != s]
            term = [(ps[s][w] - q[w], w) for w in kept if n[s][w] and ps[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, f, k + 1) for k, (f, i) in enumerate(found) if part == "pair" or k < 50]
    return sorted(out)


def divergence_rows():
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in ("wort", "é", "ÄÖ", "東", "X") for b in ("a", "bc", "ß", "zz", "q'r", "")] + ["the"] * 20
    rows = []
    for i in range(400):
        s = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "ü"])
        some = vocab if s != "s2" else vocab[:20]
        rows.append((i, rng.choice([" ", "9", "_"]).join(rng.choice(some) for _ in range(rng.randint(0, 30))),
                     rng.choice(["de", "de", "fr"]), s))
    copy = "the copied Text einsam " + "wort " * 50
    rows += [(1000 + i, copy, "de", ("s1", "s1", "s2", "s9")[i % 4]) for i in range(90)]
    rows += [(2000 + i, copy, None, "s1") for i in range(12)] + [(3000, None, "fr", "empty"), (3001, "", "fr", "empty"),
                                                                (3002, "rare words only", "xx", "b"), (3003, None, "xx", "a")]
    return rows + rows[:5]


def test_audit_equals_brute_force(spark, monkeypatch):
    rows = divergence_rows()
    df = frame(spark, rows)
    want = audit_of(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == want
    monkeypatch.setattr(divergence, "CELLS", 8)
    monkeypatch.setattr(divergence, "MOST_CELLS", 40)  # many blocks
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == want
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_equals_sql(spark):
    rows = divergence_rows()
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source"), zip(*rows)))))
    want = con.sql(oracle.SOURCE_DIVERGENCE).fetchall()
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect()) == sorted(want)


def test_repeated_texts_are_tokenized_once(spark):
    rows = divergence_rows()
    df = frame(spark, rows).fillna("", ["text", "lang", "source"])
    got = divergence.collapsed(df).collect()
    groups = defaultdict(Counter)
    for _, t, lang, s in rows:
        groups[(lang or "", t or "")][s or ""] += 1
    assert len(got) == len(groups)
    assert all({x.source: x.n for x in r.sources} == groups[(r.lang, r.text)] for r in got)


def test_terms_of_a_slice():
    texts = ["Ab'cD 7éÉ", "", "x\x7fy 東京_Z"]
    raw, off = utf8(pa.array(texts))
    doc, code, term = divergence.terms_of(raw, off)
    got = [(d, term[c].as_py()) for d, c in zip(doc.tolist(), code.tolist())]
    assert got == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(fold(t))]
