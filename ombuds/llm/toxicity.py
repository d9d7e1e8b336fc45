"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of each word are its own vector (a learned vocabulary, found by bisection in sorted
hashes) plus vectors of its first and last three characters, which also speak for unknown
words. Words are runs of letters, digits and non-ASCII bytes, ASCII lower case. Every text is
covered by overlapping windows of ``WINDOW`` words, one each ``STRIDE``; the network scores
all of them, and the highest gives the text's score through a monotone calibration.

Training: texts of a bounded sample of labelled rows (``SAMPLE`` a class, by hash order) become
windows of word hashes on the executors, at most ``TEXT_WINDOWS`` a text (by hash order; all
of them in scoring). One task fits the network on all of these, and ``FOLDS`` further tasks fit
it without one part each, whose scores of that part calibrate it. Every clean window is
drawn; which windows of a toxic text are toxic is not labelled: first those with a word of high
log odds, later those that the network itself scores highest, are positive. Texts are put in
the order of a hash of their content, so the order of the rows has no influence.

Defined results: a null or empty text is scored as one window of padding; rows without a
label or whose label is null teach nothing; without both classes every score is the share of
label 1 (0 if there is none). Repeated rows are judged each. Other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_model import isotonic
from .words import _BYTE, Words, mix, slices

WINDOW, STRIDE = 32, 16
EMBED, HIDDEN = 16, 8
#: Labelled texts of each class that are used for training, and windows of each of them, at most.
SAMPLE, TEXT_WINDOWS = 2000, 128
#: Parts of the sample whose scores come from a network that has not seen them.
FOLDS = 5
#: Training steps, at least; and windows of a step: positive, clean, clean with a high score.
STEPS, POSITIVE, CLEAN, HARD = 300, 48, 112, 32
#: Part of its way from the start that an input vector loses in each step.
FORGET = 0.15
#: Share of a training window's words that are hidden, so that no single word is learnt by heart.
HIDDEN_WORDS = 0.15
VOCABULARY = 4096
ENDS = 512
SEED = 7

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x80:] = False
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _SEPARATOR[ord(_a):ord(_b) + 1] = False
_FOLD = np.arange(256)
_FOLD[ord("A"):ord("Z") + 1] += 32
_LOWER = _BYTE[_FOLD]


class Tokens:
    """Words of a slice of texts with their hashes and end characters."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        w = Words(raw, off, _SEPARATOR)
        self.first, self.count, self.doc = w.first, w.count, w.doc
        self.hash = w.hashes(_LOWER)
        low = np.append(_FOLD[raw], [0, 0, 0]).astype(np.uint64)
        head, tail = np.zeros((2, len(w.start)), np.uint64)
        for i in range(3):
            head = head * np.uint64(257) + np.where(w.start + i < w.end, low[w.start + i], 0)
            tail = tail * np.uint64(257) + np.where(w.end - 1 - i >= w.start, low[w.end - 1 - i], 0)
        self.head = (mix(head) % np.uint64(ENDS)).astype(np.int64)
        self.tail = (mix(tail) % np.uint64(ENDS)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word index [window, WINDOW], -1 for padding; text of each window)."""
        n = 1 + np.maximum(0, -(-(self.count - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        at = (self.first[:-1][doc] + k * STRIDE)[:, None] + np.arange(WINDOW)
        return np.where(at < self.first[1:][doc][:, None], at, -1), doc


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def gru(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [time, batch, H] of one direction from projected inputs [time, batch, 3 H]."""
    steps, batch, width = x.shape
    size = width // 3
    h = np.zeros((batch, size), np.float32)
    out = np.empty((steps, batch, size), np.float32)
    for t in range(steps):
        a = h @ u
        gates = a[:, :2 * size] + x[t, :, :2 * size]
        np.negative(gates, out=gates)
        np.clip(gates, -30, 30, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :size], gates[:, size:]
        new = np.tanh(x[t, :, 2 * size:] + r * a[:, 2 * size:])
        if keep is not None:
            keep.append((h, z, r, new, a[:, 2 * size:]))
        h = new + z * (h - new)
        out[t] = h
    return out


def gru_back(d_out: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``."""
    steps, batch, size = d_out.shape
    dx, du = np.empty((steps, batch, 3 * size), np.float32), np.zeros_like(u)
    dh = np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, new, an = keep[t]
        dh = dh + d_out[t]
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        da = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ da
        dh = dh * z + da @ u.T
    return dx, du


class Network:
    """Weights, the vocabulary and the calibration; picklable and a few hundred kB."""

    def __init__(self, words: np.ndarray, odds: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.words = words  # sorted hashes; row 0 of the word vectors is for unknown words

        def normal(*shape, by=0.1):
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.p = {"word": normal(len(words) + 1, EMBED, by=0.05), "head": normal(ENDS, EMBED, by=0.02),
                  "tail": normal(ENDS, EMBED, by=0.02), "wf": normal(EMBED, 3 * HIDDEN, by=0.3),
                  "wb": normal(EMBED, 3 * HIDDEN, by=0.3), "bf": np.zeros(3 * HIDDEN, np.float32),
                  "bb": np.zeros(3 * HIDDEN, np.float32), "uf": normal(HIDDEN, 3 * HIDDEN, by=0.3),
                  "ub": normal(HIDDEN, 3 * HIDDEN, by=0.3), "q": normal(2 * HIDDEN),
                  "w": normal(2 * HIDDEN, by=0.3), "c": np.array([-2.0], np.float32)}
        self.p["word"][1:, 0] += odds.astype(np.float32) / 3  # the first component starts from the log odds
        self.start = {k: self.p[k].copy() for k in ("word", "head", "tail")}
        self.x, self.y = np.zeros(1), np.zeros(1)  # calibration: logits and their shares of label 1

    def constant(self, share: float) -> "Network":
        """This network, but every text has the same score."""
        self.x, self.y = np.zeros(0), np.full(1, share)
        return self

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        """Scores; a little of the logit itself keeps the order within a step."""
        if not len(self.x):
            return np.full(len(logit), self.y[0])
        return 0.98 * np.interp(logit, self.x, self.y) + 0.02 * sigmoid(logit / 4)

    def ids(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.words, t.hash), max(0, len(self.words) - 1))
        known = self.words[at] == t.hash if len(self.words) else np.zeros(len(t.hash), bool)
        return np.where(known, at + 1, 0), t.head, t.tail

    def tables(self) -> dict:
        """Each input vector projected for both directions; the last row is padding, which
        holds the state (update gate at one)."""
        p, out = self.p, {}
        w = np.concatenate([p["wf"], p["wb"]], 1)
        out["word"] = p["word"] @ w + np.concatenate([p["bf"], p["bb"]])
        out["head"], out["tail"] = p["head"] @ w, p["tail"] @ w
        pad = np.zeros(6 * HIDDEN, np.float32)
        pad[:HIDDEN] = pad[3 * HIDDEN:4 * HIDDEN] = 30
        out["pad"] = pad
        return out

    def forward(self, xf, xb, real, keep=None):
        """Window logits. xf: [time, batch, 3 H]; xb: the same, reversed in time; real: [time, batch]."""
        p = self.p
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([gru(xf, p["uf"], kf), gru(xb, p["ub"], kb)[::-1]], 2)
        s = np.where(real, h @ p["q"], np.float32(-1e9))
        e = np.exp(s - s.max(0))
        att = e / e.sum(0)
        pooled = (att[:, :, None] * h).sum(0)
        if keep is not None:
            keep.update(kf=kf, kb=kb, h=h, att=att, pooled=pooled)
        return pooled @ p["w"] + p["c"][0]

    def inputs(self, word, head, tail):
        """Arguments of ``forward`` for windows given by ids ([batch, time], word -1 for padding)."""
        tab, real = self.tables(), word >= 0
        x = tab["word"][np.where(real, word, 0)] + tab["head"][head] + tab["tail"][tail]
        x = np.where(real[:, :, None], x, tab["pad"]).swapaxes(0, 1)
        return x[:, :, :3 * HIDDEN], x[::-1, :, 3 * HIDDEN:], real.T

    def logits(self, t: Tokens, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(logit of every window, its text)."""
        at, doc = t.windows()
        tab = self.tables()
        word, head, tail = self.ids(t)
        x = tab["word"][word]
        x += tab["head"][head]
        x += tab["tail"][tail]
        x = np.concatenate([x, tab["pad"][None]])  # index -1
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), most):
            idx = at[i:i + most].T
            out[i:i + most] = self.forward(x[idx, :3 * HIDDEN], x[idx[::-1], 3 * HIDDEN:], idx >= 0)
        return out, doc

    def texts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Highest window logit of each text of a slice."""
        v, doc = self.logits(Tokens(raw, off))
        return np.maximum.reduceat(v, np.searchsorted(doc, np.arange(len(off) - 1)))

    def scores(self, col) -> np.ndarray:
        """Score of each text of an Arrow column."""
        parts = [self.texts(raw, off).astype(float) for _, _, raw, off in slices(col, 1 << 19)]
        return self.calibrated(np.concatenate(parts) if parts else np.zeros(0))

    def step(self, adam: dict, word, head, tail, label, weight, rate: float) -> None:
        """One Adam step on windows; word, head, tail: [batch, time], word -1 for padding."""
        p = self.p
        real = (word >= 0).T
        idx = [np.where(real, a.T, 0) for a in (word, head, tail)]
        x = p["word"][idx[0]] + p["head"][idx[1]] + p["tail"][idx[2]]
        pad = np.zeros(3 * HIDDEN, np.float32)
        pad[:HIDDEN] = 30
        xf = np.where(real[:, :, None], x @ p["wf"] + p["bf"], pad)
        xb = np.where(real[:, :, None], x @ p["wb"] + p["bb"], pad)[::-1]
        k: dict = {}
        logit = self.forward(xf, xb, real, k)
        d = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g = {"c": np.array([d.sum()], np.float32), "w": k["pooled"].T @ d}
        dp = d[:, None] * p["w"]
        h, att = k["h"], k["att"]
        da = (h * dp).sum(2)
        ds = att * (da - (att * da).sum(0))
        g["q"] = np.einsum("tb,tbh->h", ds, h)
        dh = att[:, :, None] * dp + ds[:, :, None] * p["q"]
        dxf, g["uf"] = gru_back(np.ascontiguousarray(dh[:, :, :HIDDEN]), p["uf"], k["kf"])
        dxb, g["ub"] = gru_back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), p["ub"], k["kb"])
        dxf = np.where(real[:, :, None], dxf, 0)
        dxb = np.where(real[:, :, None], dxb[::-1], 0)
        flat = x.reshape(-1, EMBED)
        g["wf"], g["wb"] = flat.T @ dxf.reshape(-1, 3 * HIDDEN), flat.T @ dxb.reshape(-1, 3 * HIDDEN)
        g["bf"], g["bb"] = dxf.sum((0, 1)), dxb.sum((0, 1))
        de = (dxf @ p["wf"].T + dxb @ p["wb"].T)[real]
        for name, i in zip(("word", "head", "tail"), idx):
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], i[real], de)
        adam["t"] = adam.get("t", 0) + 1
        for name, grad in g.items():
            m, v = adam.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad)))
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            scale = rate * np.sqrt(1 - 0.999 ** adam["t"]) / (1 - 0.9 ** adam["t"])
            p[name] -= scale * m / (np.sqrt(v) + 1e-7)
            if name in self.start:  # what few windows say of a vector is soon forgotten
                p[name] -= FORGET * (p[name] - self.start[name])


def examples(batches):
    """Batches of (key, text, label) to (key, label, words, ends): windows of word hashes and of
    end characters, as bytes; padding has ends of ``ENDS``."""
    for b in batches:
        key, label = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        rows = []
        for i, _, raw, off in slices(b.column(1), 1 << 19):
            t = Tokens(raw, off)
            at, doc = t.windows()
            nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
            with np.errstate(over="ignore"):
                order = np.lexsort((mix(key[i + doc].astype(np.uint64) + nth.astype(np.uint64)), doc))
            keep = np.sort(order[nth < TEXT_WINDOWS])
            at, doc = at[keep], doc[keep]
            real = at >= 0
            words, head, tail = (np.append(x, x.dtype.type(0))[at] for x in (t.hash, t.head, t.tail))
            words = np.where(real, words, 0).astype("<u8")
            ends = np.where(real, np.stack([head, tail]), ENDS).astype("<u2")
            first = np.searchsorted(doc, np.arange(len(off)))
            for k, (a, z) in enumerate(zip(first, first[1:])):
                rows.append((key[i + k], label[i + k], words[a:z].tobytes(), ends[:, a:z].tobytes()))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["key", "label", "words", "ends"])


class Windows:
    """Windows of labelled texts: word hashes, head and tail [window, WINDOW], their text."""

    def __init__(self, words: list[bytes], ends: list[bytes], label):
        size = np.array([len(w) // (8 * WINDOW) for w in words], np.int64)
        self.toxic = np.asarray(label, np.int64)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.words = np.frombuffer(b"".join(words), "<u8").reshape(-1, WINDOW)
        both = [np.frombuffer(e, "<u2").reshape(2, -1, WINDOW) for e in ends]
        both = np.concatenate(both, 1) if both else np.zeros((2, 0, WINDOW), "<u2")
        self.real = both[0] < ENDS
        self.head, self.tail = (np.where(self.real, x, 0).astype(np.int32) for x in both)

    def of(self, texts: np.ndarray) -> "Windows":
        """The windows of some texts, which are numbered anew."""
        number = np.full(len(self.toxic), -1)
        number[texts] = np.arange(len(texts))
        rows = np.flatnonzero(number[self.doc] >= 0)
        out = object.__new__(Windows)
        out.toxic, out.doc = self.toxic[texts], number[self.doc[rows]]
        out.words, out.real, out.head, out.tail = (x[rows] for x in (self.words, self.real, self.head, self.tail))
        return out

    def ids(self, net: "Network") -> np.ndarray:
        """Rows of the word vectors; -1 for padding."""
        at = np.minimum(np.searchsorted(net.words, self.words), max(0, len(net.words) - 1))
        known = net.words[at] == self.words if len(net.words) else np.zeros(self.words.shape, bool)
        return np.where(self.real, np.where(known, at + 1, 0), -1).astype(np.int32)

    def logits(self, net: "Network", ids: np.ndarray) -> np.ndarray:
        parts = [net.forward(*net.inputs(ids[i:i + 1024], self.head[i:i + 1024], self.tail[i:i + 1024]))
                 for i in range(0, len(ids), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def best(self, net: "Network") -> np.ndarray:
        """Highest logit of each text."""
        v = self.logits(net, self.ids(net))
        return np.maximum.reduceat(v, np.searchsorted(self.doc, np.arange(len(self.toxic)))) if len(v) else v


def vocabulary(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted word hashes, their clipped log odds, which are hot: surely more often in toxic texts)."""
    cut = np.searchsorted(w.doc, np.arange(len(w.toxic) + 1))
    own = [np.unique(w.words[i:j][w.real[i:j]]) for i, j in zip(cut, cut[1:])]  # text by text, as memory goes
    size = [len(x) for x in own]
    h, at = np.unique(np.concatenate(own), return_inverse=True)
    y = np.repeat(w.toxic, size)
    c = np.stack([np.bincount(at[y == k], minlength=len(h)) for k in (0, 1)], 1).astype(float)
    n1, n0 = int(w.toxic.sum()), int((1 - w.toxic).sum())
    odds = np.log((c[:, 1] + 0.5) / (n1 + 1)) - np.log((c[:, 0] + 0.5) / (n0 + 1))
    sure = np.abs(odds) * np.sqrt(c.sum(1))
    often = c.sum(1) >= 3
    pick = np.zeros(len(h), bool)
    for key in (sure, c.sum(1)):
        rank = np.lexsort((h, -np.where(often, key, -1)))[:VOCABULARY // 2]
        pick[rank[often[rank]]] = True
    # likelihood ratio of a word's two shares against one; among k words chance alone reaches 2 log k
    share = np.array([n0, n1]) / (n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * np.where(c > 0, c * np.log(c / (c.sum(1)[:, None] * share)), 0).sum(1)
    ratio = np.where(pick & (odds > 0), ratio, 0)
    hot = (ratio > 0) & (ratio >= min(2 * np.log(max(2, pick.sum())), 0.75 * ratio.max(initial=0)))
    return h[pick], np.clip(odds[pick], -4, 6), hot[pick]


def fit(w: Windows, steps: int = STEPS, seed: int = SEED) -> Network:
    """Train on the windows of labelled texts of both classes; not calibrated."""
    words, odds, hot = vocabulary(w)
    net = Network(words, np.where(hot | (odds < 0), odds, 0), seed)
    ids = w.ids(net)
    flag = np.append(hot, [False, False])[ids - 1].any(1)  # unknown: -1, padding: -2
    bad = w.toxic[w.doc] == 1
    clean = np.flatnonzero(~bad)
    positive, hard = np.flatnonzero(bad & flag), clean
    if not len(positive):
        positive = np.flatnonzero(bad)
    rng = np.random.default_rng(seed)
    steps = max(steps, -(-len(clean) // CLEAN))  # so that each clean window is drawn
    order, adam = rng.permutation(clean), {}
    for step in range(steps):
        if step in (steps // 4, steps // 2, 3 * steps // 4):
            score = w.logits(net, ids)
            own = np.flatnonzero(bad & (score > 0) & flag | bad & (score > 1.5))
            positive = own if len(own) else positive
            hard = clean[np.argsort(-score[clean], kind="stable")[:max(HARD, len(clean) // 20)]]
        at = step * CLEAN % len(order) + np.arange(min(CLEAN, len(order)))
        rows = np.concatenate([rng.choice(positive, POSITIVE), order[at % len(order)], rng.choice(hard, HARD)])
        label = np.arange(len(rows)) < POSITIVE
        rate = 0.01 * min(1.0, 0.1 + 1.8 * (1 - step / steps))
        word = np.where(rng.random((len(rows), WINDOW)) < HIDDEN_WORDS, -1, ids[rows])
        net.step(adam, word, w.head[rows], w.tail[rows], label.astype(float), np.where(label, 1.5, 1.0), rate)
    return net


def fit_part(key, rows):
    """One task of the training: the network fitted without part ``fold`` of the texts (on all of
    them where there is no such part), and its highest logit and the label of each left-out text."""
    fold = key[0].as_py()
    rows = rows.sort_by([("label", "ascending"), ("key", "ascending")])
    w = Windows(rows.column("words").to_pylist(), rows.column("ends").to_pylist(), rows.column("label").to_numpy())
    del rows
    ones = int(w.toxic.sum())
    nth = np.arange(len(w.toxic)) - np.where(w.toxic == 1, len(w.toxic) - ones, 0)
    out = nth % FOLDS == fold if min(ones, len(w.toxic) - ones) >= FOLDS else np.zeros(len(nth), bool)
    if fold < FOLDS and not out.any():
        return pa.table({"fold": pa.array([], pa.int32()), "net": pa.array([], pa.binary()),
                         "logit": pa.array([], pa.list_(pa.float64())), "label": pa.array([], pa.list_(pa.int32()))})
    told, seen = (w.of(np.flatnonzero(out)), w.of(np.flatnonzero(~out))) if out.any() else (w, w)
    del w
    net = fit(seen)
    return pa.table({"fold": pa.array([fold], pa.int32()), "net": pa.array([pickle.dumps(net)], pa.binary()),
                     "logit": pa.array([told.best(net).astype(float).tolist()], pa.list_(pa.float64())),
                     "label": pa.array([told.toxic.tolist()], pa.list_(pa.int32()))})


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic shares of label 1 by the highest logit, at the classes' true shares. Unlike a
    logistic curve they are not bent by labels that no text can explain."""
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    at, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse, w)
    return at, isotonic(at, np.bincount(inverse, w * y) / weight, weight)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Network from rows (id, ``label`` 0/1) of ``labels``; a doubly labelled id counts as toxic.

    Chosen ids (at most 2 x ``SAMPLE``, so broadcast) pick the texts in the scan.
    """
    known = (labels.where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max("label").cast("int").alias("label")))
    count = known.agg(F.count("*"), F.sum("label")).first()
    share = float((count[1] or 0) / count[0]) if count[0] else 0.0
    if not count[1] or count[1] == count[0]:
        return Network(np.zeros(0, np.uint64), np.zeros(0)).constant(share)
    ids = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for y in (0, 1)]
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .where("text is not null").join(F.broadcast(ids[0].unionAll(ids[1])), "id")
            .select(F.xxhash64("text").alias("key"), "text", "label").distinct())
    windows = rows.mapInArrow(examples, "key long, label int, words binary, ends binary")
    parts = windows.select("*", F.explode(F.array(*map(F.lit, range(FOLDS + 1)))).alias("fold"))
    fitted = parts.groupBy("fold").applyInArrow(
        fit_part, "fold int, net binary, logit array<double>, label array<int>").collect()
    final = [r for r in fitted if r.fold == FOLDS]
    if not final:  # the labelled documents are not there
        return Network(np.zeros(0, np.uint64), np.zeros(0)).constant(share)
    net = pickle.loads(final[0].net)
    told = [r for r in fitted if r.fold < FOLDS] or final
    x, y = (np.array([v for r in told for v in r[name]]) for name in ("logit", "label"))
    if not 0 < y.sum() < len(y):
        return net.constant(share)
    net.x, net.y = calibrate(x, y, share)
    return net


def score(text: Column, net: Network) -> Column:
    """Column of the score of each whole text."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(net.scores(texts))

    return run(text.cast("string"))
