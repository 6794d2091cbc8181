"""Quality model: held-out accuracy, its parts against plain computations, edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from moodloom.llm import nbsvm

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = nbsvm.scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def made(n, seed=3):
    rng = random.Random(seed)
    good, bad = "apple river stone green walk".split(), "WIN$$ cash*** CLICK!! now"
    rows, labels = [], []
    for i in range(n):
        quality = rng.random() < 0.7
        rows.append((i, " ".join(rng.choice(good) if quality else rng.choice(bad.split() + good) for _ in range(rng.randint(5, 60)))))
        labels.append((i, int(quality)))
    return rows, labels


def scored(spark, rows, labels, **more):
    docs = spark.createDataFrame([(*r, "x", 5, 1) for r in rows], "doc_id long, text string, key string, label int, quality int")
    return nbsvm.scores(docs, spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, text string"), bits=12, **more).collect()


def test_odd_rows(spark):
    rows, labels = made(200)
    rows += [(None, "apple"), (None, None), (1000, ""), (1001, None), (1002, " \n"), (1003, "apple river " * 30_000), (5, "again"), (5, "again")]
    labels += [(None, 1), (1000, None), (7, 1 - labels[7][1]), (999_999, 1), (8, labels[8][1])]
    out = scored(spark, rows, labels)
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1000, 1001, 1002)}) == 1
    truth = dict(labels[:200])
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 200 and r.doc_id not in (5, 7)]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_one_class_or_none(spark):
    rows, _ = made(20)
    assert {r.score for r in scored(spark, rows, [])} == {0.5}
    assert len({r.score for r in scored(spark, rows, [(i, 1) for i in range(20)])}) == 1
    assert scored(spark, [], []) == []


def test_held_out_labels_change_nothing(spark):
    rows, labels = made(150)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    assert sorted(scored(spark, rows, labels)) == sorted(scored(spark, rows, flipped))


def test_small_sample_and_class_counts(spark):
    rows, labels = made(300)
    out = [r for r in scored(spark, rows, labels, sample=40) if r.held_out]
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in out) >= 0.85 * len(out)
    table = spark.createDataFrame([(i, t, q) for (i, t), (_, q) in zip(rows, labels, strict=True)], "key long, text string, label int").repartition(4)
    counts = nbsvm.class_counts(table, 12)
    want = np.zeros_like(counts)
    for (_, t), (_, q) in zip(rows, labels, strict=True):
        body = np.frombuffer(t.encode(), np.uint8)
        want[q, nbsvm.indicators(body, np.array([0, len(body)]), 12)[0]] += 1
        want[q, -1] += 1
    assert (counts == want).all()


def test_indicators_do_not_depend_on_the_batch():
    texts = ["a b a b a b", "", "One two TWO!! three*** three*** x", "a", "\n\n", "é é é é"]
    blob = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blob])])
    flat, begin = nbsvm.indicators(np.frombuffer(b"".join(blob), np.uint8), at)
    for i, b in enumerate(blob):
        own = nbsvm.indicators(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        assert own.tolist() == flat[begin[i]:begin[i + 1]].tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_descent_reaches_the_optimum(seed):
    """Primal and dual values of the hinge-loss problem meet."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 6))
    sign = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    bound = np.full(60, 0.7)
    w = nbsvm.descended([np.arange(6)] * 60, list(x), sign, 6, bound)
    primal = 0.5 * w @ w + (bound * np.maximum(0, 1 - sign * (x @ w))).sum()
    best = min(0.5 * v @ v + (bound * np.maximum(0, 1 - sign * (x @ v))).sum() for v in w + 0.02 * rng.normal(size=(4000, 6)))
    assert primal <= 1.005 * best
