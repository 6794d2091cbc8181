"""Centroid clustering: zone maps against plain k-means, edge cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from moodloom.llm import zones

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, place long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, 1) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, width, scale=256):
    """Lloyd's algorithm in whole numbers, one vector after the other."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), m) for m, c in enumerate(centroids))

    for _ in range(rounds):
        own = [best(v)[1] for _, v in kept]
        for m in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == m]
            if mine:
                centroids[m] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *best(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in out)
    per = {m: sum(d for _, c, d in out if c == m) for m in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, m, d, per[m], total, sha[m]) for i, m, d in out), key=str)


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "spread"), [(0, 1), (3, 1), (700, 0.02), (700, 3.0)])
def test_equals_plain_clustering(spark, n, spread):
    rng = np.random.default_rng(n)
    middles = rng.normal(size=(9, 8))
    rows = [(i, (middles[i % 9] + spread * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    assert got(zones.clustered(frame(spark, rows), k=12, rounds=4, width=8)) == plain(rows, 12, 4, 8)


def test_odd_vectors(spark):
    good = [0.5, -0.25, 1.0, 0.0]
    rows = [(1, good), (1, good), (None, good), (None, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]),
            (5, [1.0, float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0]), (7, [-0.001, 0.001, 300.0, -300.0])]
    rows += [(8, good)] * 500
    result = got(zones.clustered(frame(spark, rows), k=5, rounds=3, width=4))
    assert result == plain(rows, 5, 3, 4) and len(result) == 504


def test_large_components(spark):
    """Beyond exact doubles whole numbers are used; beyond 64 bits an error is raised."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.uniform(-400_000, 400_000, 4).astype(np.float32).tolist()) for i in range(60)]
    assert got(zones.clustered(frame(spark, rows), k=6, rounds=2, width=4)) == plain(rows, 6, 2, 4)
    with pytest.raises(Exception, match="too large"):
        zones.clustered(frame(spark, [(1, [1e9, 0.0, 0.0, 0.0])]), k=2, rounds=1, width=4).collect()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(1)
    for size in (1, 2, 30):
        points = rng.integers(-20, 20, (40, size, 3))
        centroids = rng.integers(-20, 20, (15, 3))
        centroids[7] = centroids[3]
        open_ = zones.candidates(points.min(axis=1), points.max(axis=1), centroids)
        for block, own in zip(points, open_, strict=True):
            assert own[zones.nearest(block, centroids)[0]].all()
        if size == 1:
            assert (open_.sum(axis=1) == 1).all() and not open_[:, 7].any()


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = zones.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()
