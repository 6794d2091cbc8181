"""Repeated-passage removal against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from moodloom.llm import suffix


def expected(texts, length):
    found = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if found[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    words = ["alpha", "beta", "gämma", "delta", "eps", "zeta", "eta", "theta", "iota", "k"]

    def text(n):
        return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))

    shared = [text(20) for _ in range(4)]
    docs = []
    for i in range(60):
        body = text(rng.randrange(0, 60))
        if i % 3 == 0:
            body += shared[i % 4] + text(5)
        if i % 7 == 0:
            body = text(3) + shared[1] + body
        docs.append(body)
    docs += [docs[3]] * 4 + [docs[5][:-4] + "x" + docs[5][-3:], "ab " * 80, "ab " * 60, "z" * 150, "", None, "short"]
    return docs


@pytest.mark.parametrize("most", [4096, 2])
def test_spans_equal_brute_force(spark, most):
    docs = corpus()
    rows = [(i, t) for i, t in enumerate(docs)] + [(3, docs[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix.deduplicated(df, 60, 8, most).collect()
    want = expected([(t or "").encode() for _, t in rows], 60)
    have = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert have == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_matching_statistics_of_the_index():
    texts = [b"abracadabra", b"xabracax", b"aaaaaaa", b"q", b""]
    best = suffix.RunIndex(texts).matches()
    joined, at = b"", 0
    every = [(t, i) for t in texts for i in range(len(t))]
    for t in texts:
        for i in range(len(t)):
            want = max(len(common(t[i:], u[j:])) for u, j in every if (u, j) != (t, i))
            assert best[at + i] == want
        at += len(t) + 1
    assert joined == b""


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string, key string")
    assert suffix.removal_report(df).count() == 0
