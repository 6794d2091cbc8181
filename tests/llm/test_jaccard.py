"""Near-duplicate components against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from moodloom.llm import jaccard
from moodloom.llm.graph import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(n=260):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(400))
    base = [[word() for _ in range(rng.choice((3, 5, 9, 40, 90)))] for _ in range(25)]
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = word()
        if i % 9 == 0:
            words = words[:20] + passage
        rows.append((i * 3 + 1, " ".join(w.upper() if i % 5 == 0 else w for w in words)))
    return rows + [(2, ""), (5, None), (8, " \n\t "), (1, rows[0][1]), (1, rows[7][1]), (11, rows[4][1] + "\n"), (14, "a b")]


@pytest.mark.parametrize("block", [20_000, 3])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "LIST", block)
    monkeypatch.setattr(jaccard, "SOME", 4)
    rows = corpus()
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(rows)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f", 1), (2, "A b c d e f", 2), (2, "A b c d e f", 2), (4, "x y", 3), (5, None, 4), (5, None, 4)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id, r.n) for r in kept) == [(2, 2), (4, 3), (5, 4), (5, 4)]


def test_empty_table(spark):
    assert jaccard.near_groups(spark.createDataFrame([], "doc_id long, text string, component long")).count() == 0


def test_histograms_bound_the_overlap():
    rng = np.random.default_rng(1)
    for size in (1, 5, 40, 700, 9000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[:size * 3 // 4], rng.integers(0, 1 << 63, size // 2, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert jaccard.difference(jaccard.histogram(a), jaccard.histogram(b)) <= apart
        assert size < 40 or jaccard.difference(jaccard.histogram(a), jaccard.histogram(b)) > apart // 3


@pytest.mark.parametrize("few", [500_000, 0])
def test_components(spark, few):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), few).collect()}
    least = {x: x for e in edges for x in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {x: m for x, m in least.items() if sum(m == y for y in least.values()) > 1}


def test_sets_that_share_many_lists_are_paired_once(spark):
    # 30 sets of 120 shingles, 32 of them rare in all of them: they meet in over twenty lists, and histograms keep every pair.
    shared = list(range(1, 33))
    rows, sets = [], []
    for i in range(30):
        own = [(1 << 57) + 1000 * i + k for k in range(88)]
        for at, shingle in enumerate((shared + own)[:jaccard.prefix_length(120)]):
            rows.append((shingle, i + 1, (120 << 32) | at))
        sets.append((i + 1, bytearray(jaccard.RANGES)))
    shared_rows = spark.createDataFrame(rows, "shingle long, id long, meta long")
    found = spark.createDataFrame([], "node long, component long")
    spread = spark.createDataFrame(sets, "id long, spread binary")
    pairs = jaccard.meetings(shared_rows, found, spread)
    every = sorted((a, b) for a in range(1, 31) for b in range(1, a))
    assert sorted(tuple(r) for r in pairs.collect()) == every
    assert sorted(tuple(r) for r in jaccard.crossing(shared_rows, found, spread).collect()) == every
