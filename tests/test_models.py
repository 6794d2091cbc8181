"""Fits, ranks and tests against brute force on small fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moodloom.operators import inference as inf
from moodloom.operators import models as md
from moodloom.operators import ranks as rk
from moodloom.operators import aggregates as ag
from moodloom.sources import sinks
from moodloom.sources import tables as tb


def series(spark, n=150, seed=1, change_from=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = x @ [0.5, -0.2, 0.0] + rng.normal(size=n) * 0.3
    if change_from is not None:
        x[change_from:] += 5
        y[change_from:] -= 3
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["target_5d"] = y
    pdf["date"] = pd.date_range("2020-01-01", periods=n).date
    return spark.createDataFrame(pdf), pdf


def test_ridge_matches_brute_force():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 4)), rng.normal(size=40)

    def fit(xs, ys, alpha):
        xc, yc = xs - xs.mean(0), ys - ys.mean()
        return np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)

    losses = []
    for alpha in md.PENALTIES:
        errors = []
        for i in range(40):
            keep = np.arange(40) != i
            b = fit(x[keep], y[keep], alpha)
            errors.append(y[i] - y[keep].mean() - (x[i] - x[keep].mean(0)) @ b)
        losses.append(np.mean(np.square(errors)))
    best = md.PENALTIES[int(np.argmin(losses))]
    np.testing.assert_allclose(md.ridge_weights(x, y), fit(x, y, best), rtol=1e-8)


def test_signed_ridge_is_optimal():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=60)
    signs = np.array([1, 1, -1, -1.0])
    b = md.signed_weights(x, y, signs, np.zeros(4))
    slope = -2 * x.T @ (y - x @ b) + 2 * b
    assert np.all(b * signs >= 0)
    assert np.all(np.where(b != 0, np.abs(slope) < 1e-6, slope * signs >= -1e-6))


def test_walk_forward_matches_brute_force_and_does_not_leak(spark):
    df, pdf = series(spark)
    got = md.walk_forward_scores(df, ["a", "b", "c"], [1, -1, 1], block=32).toPandas().sort_values("date").set_index("date")["raw_score"]
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["target_5d"].to_numpy()
    for t in (60, 95, 149):
        mean, std = x[:t].mean(0), x[:t].std(0)
        coef = md.ridge_weights(np.clip((x[:t] - mean) / std, -3, 3), y[:t]) * [1, -1, 1]
        want = np.clip((x[t] - mean) / std, -3, 3) @ (coef / (np.abs(coef).sum() + 1e-12))
        assert got[pdf["date"][t]] == pytest.approx(want, abs=1e-10)
    changed, _ = series(spark, change_from=120)
    later = md.walk_forward_scores(changed, ["a", "b", "c"], [1, -1, 1], block=32).toPandas().sort_values("date").set_index("date")["raw_score"]
    before = pdf["date"][:120]
    pd.testing.assert_series_equal(got[got.index.isin(before)], later[later.index.isin(before)])
    assert len(got) == 90


def test_index_scale(spark):
    df, _ = series(spark)
    out = md.walk_forward_index(df, ["a", "b", "c"], [1, 1, 1]).toPandas()["index_score"]
    assert out.min() == pytest.approx(0.0) and out.max() == pytest.approx(100.0, abs=1e-6) and len(out) == 90


def test_static_index_matches_numpy(spark):
    df, pdf = series(spark)
    got = md.static_index(df, ["a", "b", "c"], "target_5d", "2020-04-09").toPandas().sort_values("date")["index_score"].to_numpy()
    train = (pd.to_datetime(pdf["date"]) <= "2020-04-09").to_numpy()
    x = pdf[["a", "b", "c"]].to_numpy()
    z = (x - x[train].mean(0)) / x[train].std(0)
    y = pdf["target_5d"].to_numpy()[train]
    zt, yc = z[train], y - y.mean()
    losses, coefs = [], []
    for alpha in (0.1, 1.0, 10.0):
        inverse = np.linalg.inv(zt.T @ zt + alpha * np.eye(3))
        b = inverse @ zt.T @ yc
        h = 1 / len(yc) + np.einsum("ij,jk,ik->i", zt, inverse, zt)
        losses.append(np.mean(((yc - zt @ b) / (1 - h)) ** 2))
        coefs.append(b)
    b = coefs[int(np.argmin(losses))]
    raw = z @ (b / np.abs(b).sum())
    lo, hi = np.percentile(raw[train], [1, 99])
    np.testing.assert_allclose(got, 100 * (np.clip(raw, lo, hi) - lo) / (hi - lo), atol=1e-8)


@pytest.mark.parametrize("per_block", [50_000, 3])
def test_quantiles_and_ranks(spark, monkeypatch, per_block):
    monkeypatch.setattr(rk, "VALUES_PER_BLOCK", per_block)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 900), "v": np.concatenate([rng.exponential(size=900), rng.integers(0, 40, 900)])})
    df = spark.createDataFrame(pdf).withColumn("i", F.monotonically_increasing_id())
    got = {(r["g"], r["q"]): r["value"] for r in rk.quantiles(df, "v", [0.0, 0.05, 0.5, 0.99, 1.0], "g").collect()}
    for (g, q), value in got.items():
        assert value == pytest.approx(np.quantile(pdf[pdf.g == g].v, q), abs=1e-12)
    assert len(got) == 10
    ranks = rk.average_rank(df, "v", "g").toPandas()
    np.testing.assert_allclose(ranks["rank"], ranks.groupby("g")["v"].rank())


def test_p_values(spark):
    # Tabled values of Student's t: 2.228 leaves 5 % at 10 degrees of freedom, 1.96 at very many.
    df = spark.createDataFrame([(2.228139, 10.0), (1.959964, 1e7), (0.0, 5.0)], "t double, d double")
    got = [r["p"] for r in df.select(inf.two_sided_p("t", "d").alias("p")).collect()]
    assert got == pytest.approx([0.05, 0.05, 1.0], abs=1e-6)


def test_bootstrap_is_repeatable(spark):
    df, _ = series(spark)
    runs = [inf.bootstrap_spearman(df, "a", "c", "target_5d", 50).first().asDict() for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]["replicates"] == 50
    pdf = df.toPandas()
    assert runs[0]["rho_a"] == pytest.approx(pdf["a"].rank().corr(pdf["target_5d"].rank()))
    assert runs[0]["p_value"] < 0.05


def test_stratified_sample(spark):
    df = spark.range(3000).select(F.col("id").alias("comment_id"), (F.col("id") % 3).alias("year"))
    a, b = (ag.stratified_sample(df, "year", 50, seed=4) for _ in range(2))
    assert {r["count"] for r in a.groupBy("year").count().collect()} == {50}
    assert sorted(a.collect()) == sorted(b.collect())


def test_csv_encodings(spark, tmp_path):
    for i, encoding in enumerate(["utf-8-sig", "utf-8", "cp949"]):
        path = tmp_path / f"t{i}.csv"
        path.write_bytes("날짜,종가\n2020-01-02,\"1,5\"\n".encode(encoding))
        df = tb.read_table_smart(spark, str(path))
        assert df.columns == ["날짜", "종가"] and df.first()["종가"] == "1,5"
        assert tb.normalize_date(df).columns[0] == "date"


def test_parse_years():
    assert tb.parse_years("2014-2016, 2019,2015") == [2014, 2015, 2016, 2019]


def test_append_keeps_each_key_once(spark):
    batch = spark.createDataFrame([("n1", "c1", 1), ("n1", "c1", 2), ("n1", "c2", 3)], "news_id string, comment_id string, i int")
    first = sinks.incremental_append(batch, None, ["news_id", "comment_id"], "i")
    assert sorted(r["i"] for r in first.collect()) == [1, 3]
    assert sinks.incremental_append(batch, first, ["news_id", "comment_id"], "i").count() == 0


def test_write_split_reruns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).select("id", (F.col("id") % 2 + 2020).alias("year"))
    for _ in range(2):
        sinks.write_split(df, path, F.when(F.col("id") < 4, "kept").otherwise("dropped"))
    assert spark.read.parquet(path).count() == 10
    assert spark.read.parquet(path).where("disposition = 'kept'").count() == 4
