"""Small brute-force versions and awkward rows."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows with nulls, blanks, ties and repeats; extra columns clash with names of results.
EXTRA = "score string, n_words int, kept string, root int, lang string, source string"


def rows_of(texts, first=0):
    return [(first + i, t, "x", 1, "y", 2, None, None) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, " + EXTRA


def removed_by_windows(docs, window=20):
    """{id: (words, removed flags)}: words covered by a window that also starts earlier."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        out[i] = (words, gone)
    return out


def bag(text, k=5):
    words = WORD.findall(text or "")
    return Counter(tuple(words[i:i + k]) for i in range(max(0, len(words) - k + 1))) if len(words) >= k \
        else Counter([tuple(words)] if words else [])


def probability_jaccard(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys())
    return total


def classes(docs, threshold=0.8):
    """{id: least id of its class} by all pairs."""
    bags = [(i, bag(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(bags):
        for j, y in bags[:a]:
            if x and y and (x == y or x.keys() & y.keys() and probability_jaccard(x, y) >= threshold):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i, _ in docs}
