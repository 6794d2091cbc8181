"""Boosted trees: one round against an exhaustive search, series side by side, weights, folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from moodloom.operators import boosting as bo
from moodloom.operators import models as md
from pyspark.sql import functions as F


def data(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] + 0.1 * rng.normal(size=n)
    return x, y


def searched(x, y, w, rows, depth, least):
    """Prediction function of one tree, every cut between values being tried by its weighted squared error."""
    mean = np.average(y[rows], weights=w[rows])
    best = None
    if depth:
        whole = (w[rows] * (y[rows] - mean) ** 2).sum()
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                sides = [rows[x[rows, f] <= cut], rows[x[rows, f] > cut]]
                if min(map(len, sides)) >= least:
                    left = sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in sides)
                    if whole - left > 1e-9 and (best is None or whole - left > best[0] + 1e-9):
                        best = (whole - left, f, cut, sides)
    if best is None:
        return lambda v: mean
    _, f, cut, sides = best
    low, high = (searched(x, y, w, s, depth - 1, least) for s in sides)
    return lambda v: low(v) if v[f] <= cut else high(v)


@pytest.mark.parametrize(("depth", "least"), [(1, 1), (2, 20), (3, 5)])
def test_one_round_equals_an_exhaustive_search(depth, least):
    x, y = data()
    w = np.random.default_rng(3).uniform(0.5, 2, len(y))
    train = np.arange(len(y)) < 180
    got, gains = bo.boosted(x, y, w, train, bo.Trees(1, 1.0, depth, least=least))
    start = np.average(y[train], weights=w[train])
    tree = searched(x, y - start, w, np.flatnonzero(train), depth, least)
    assert np.allclose(got, [start + tree(v) for v in x]) and np.isclose(gains.sum(), 1) and gains[2] < 0.2


def test_many_rounds_learn_both_losses():
    x, y = data(600)
    train = np.arange(600) < 400
    out, _ = bo.boosted(x, y, np.ones(600), train, bo.Trees(200, 0.1, 3))
    assert np.sqrt(np.mean((out - y)[~train] ** 2)) < 0.35 * y.std()
    label = (y > 0).astype(float)
    out, _ = bo.boosted(x, label, np.ones(600), train, bo.Trees(200, 0.1, 3, loss="logistic"))
    assert ((out > 0) & (out < 1)).all() and ((out > 0.5) == (label > 0))[~train].mean() > 0.95


def test_weights_are_repetitions():
    x, y = data(120)
    twice = np.arange(120) % 3 == 0
    weighted, _ = bo.boosted(x, y, np.where(twice, 2.0, 1.0), np.ones(120, bool), bo.Trees(20, 0.3, 2, least=1))
    more = np.concatenate([np.arange(120), np.flatnonzero(twice)])
    repeated, _ = bo.boosted(x[more], y[more], np.ones(len(more)), np.ones(len(more), bool), bo.Trees(20, 0.3, 2, least=1))
    # Quantile edges differ where rows repeat, unless there are as many bins as values.
    assert len(np.unique(x)) < bo.BINS and np.allclose(weighted, repeated[:120])


def table(spark, seeds):
    parts = []
    for s in seeds:
        x, y = data(150, s)
        parts.append(pd.DataFrame(x, columns=["a", "b", "c"]).assign(series=f"s{s}", target_5d=y, date=pd.date_range("2020-01-01", periods=150).date,
                                                                     weight=np.where(np.arange(150) == 3, 0.0, 1.0)))
    return spark.createDataFrame(pd.concat(parts)).withColumn("a", F.when((F.col("series") == "s1") & (F.dayofmonth("date") == 7), None).otherwise(F.col("a")))


def test_series_are_fitted_apart(spark):
    df = table(spark, [1, 2])
    errors, predictions = md.ts_cv(df, ["a", "b", "c"], k=3, rounds=15, step=0.2, by="series", share=1.0)
    rows = errors.collect()
    assert sorted((r.series, r.fold) for r in rows) == [(f"s{s}", f) for s in (1, 2) for f in (1, 2, 3)]
    alone, _ = md.ts_cv(df.where("series = 's2'"), ["a", "b", "c"], k=3, rounds=15, step=0.2, share=1.0)
    assert {r.fold: round(r.rmse, 9) for r in alone.collect()} == {r.fold: round(r.rmse, 9) for r in rows if r.series == "s2"}
    own = [r.rmse for r in rows if r.series == "s1"]
    assert np.allclose([(r.rmse_mean, r.rmse_std) for r in rows if r.series == "s1"], (np.mean(own), np.std(own)))
    assert predictions.where("pred_5d is null").count() == 0 and predictions.groupBy("series").count().count() == 2


def test_folds_are_the_last_blocks(spark):
    df = table(spark, [2])
    folds = [r.fold for r in md.fold_ids(df, 4, by="series").orderBy("date").collect()]
    assert folds == [0] * 30 + [f for f in (1, 2, 3, 4) for _ in range(30)]
    assert {r.fold for r in md.fold_ids(df.limit(3), 5).collect()} == {0}


def test_importance_and_comparison(spark):
    df = table(spark, [1, 2])
    rows = md.feature_importance(df, ["a", "b", "c"], k=3, rounds=30, step=0.2, by="series", families={"signal": "a|b"}).collect()
    for name in ("s1", "s2"):
        own = {r.feature: r for r in rows if r.series == name}
        assert np.isclose(sum(r.importance for r in own.values()), 1) and own["a"].importance > own["c"].importance
        assert np.isclose(own["a"].family_share, own["a"].importance + own["b"].importance) and own["c"].family == "other"
    df = df.withColumns({"up": (F.col("target_5d") > 0).cast("int"), "next": F.col("target_5d") / 100})
    out = md.gbt_compare(df, {"one": ["a"], "all": ["a", "b", "c"]}, {"reg": "target_5d", "cls": "up"}, "2020-04-15", "weight", "next", rounds=40, step=0.2, by="series")
    best = {(r.series, r.model): r.s for r in out.groupBy("series", "model").agg(F.sum("strat_ret").alias("s")).collect()}
    assert len(best) == 8 and out.where("date <= '2020-04-15'").count() == 0
    assert all(best[s, f"{k}_all"] > 0 for s in ("s1", "s2") for k in ("reg", "cls"))


def test_nothing_to_learn_from(spark):
    df = table(spark, [1])
    assert md.ts_cv(df.limit(0), ["a", "b"], k=2, rounds=2)[0].count() == 0
    assert md.feature_importance(df.withColumn("target_5d", F.lit(None).cast("double")), ["a"], k=2, rounds=2).count() == 0
