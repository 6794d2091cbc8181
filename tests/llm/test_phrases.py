"""Collocations against plain counting; filters against what went into them."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from moodloom.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, best, share=80):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for s in range(1, 5):
                f.update(tuple(words[i:i + s]) for i in range(len(words) - s + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer.get(p[i:i + m], 0), a)
        rows_ = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer.get(p, 0) < share * a:
                rows_.append((score, a, " ".join(p), f[p[:k]], f[p[k:]], k))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, r[2], r[1], r[3], r[4], n[lang], r[0], r[5]) for i, r in enumerate(rows_[:best])]
    return sorted(out, key=str)


def corpus(n):
    rng = random.Random(n)
    words = "the of Cold WAR new york city é naïve a 1 x-y don't".split() + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " of the new york city "]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None, "und", ""])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", i) for i, r in enumerate(rows)], "text string, lang string, run long, word string, doc_id long")


@pytest.mark.parametrize("held", [1 << 21, 64])
def test_equals_plain_counting(spark, held, monkeypatch):
    """With little held at a time there are many filters of many shards."""
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "SHARD", held)
    rows = corpus(250) + [(None, "en"), ("", None), ("Big  Apple " * 3000, "en"), ("A" * 100_000, "de"), ("no delimiter", None)] + [("same same text", "fr")] * 40
    got = sorted((tuple(r) for r in phrases.collocations(frame(spark, rows).repartition(5), least=4, best=40).collect()), key=str)
    assert got == plain(rows, 4, 40)


def test_nothing_to_find(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [("a b c", "en"), (None, None)])).count() == 0


@pytest.mark.parametrize(("size", "bits"), [(2, 1), (2, 30), (3, 7), (3, 21), (4, 16), (4, 18), (4, 30)])
def test_keys_and_filters_lose_nothing(size, bits):
    rng = np.random.default_rng(bits)
    own = phrases.Packing(size, bits)
    words = [rng.integers(1, 1 << bits, 3000) for _ in range(size)]
    left, right = own.keys(words)
    assert all((a == b).all() for a, b in zip(own.words(left, right), words, strict=True))
    want = Counter(zip(*(w.tolist() for w in words), strict=True))
    times = rng.integers(1, 600, 3000)
    times[5] = 1 << 40
    counts = Counter()
    for key, t in zip(zip(*(w.tolist() for w in words), strict=True), times.tolist(), strict=True):
        counts[key] += t
    left, right, total = phrases.counted(left, right, times, own)
    assert len(left) == len(want)
    lead = min(3, own.half)
    found = Counter()
    shard = (left >> np.uint64(own.half - lead)).astype(int)
    for s in np.unique(shard).tolist():
        here = shard == s
        data = phrases.to_filter(left[here], right[here], total[here], own, lead)
        a, b, n = phrases.from_filter(data, own, lead, s)
        assert (a == left[here]).all() and (b == right[here]).all()
        for key, t in zip(zip(*(w.tolist() for w in own.words(a, b)), strict=True), n.tolist(), strict=True):
            found[key] += t
    assert found == counts
