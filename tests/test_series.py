"""Window operators against plain pandas, and spans against plain windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moodloom.operators import windows as wn
from moodloom.operators.series import Spans, running, with_position

SPANS = Spans("to_date(date)", 16)


def make(spark, n=400, seed=3, ties=False, groups=("a", "b")):
    rng = np.random.default_rng(seed)
    parts = []
    for g in groups:
        x = rng.integers(0, 5, n).astype(float) if ties else rng.normal(size=n)
        x[rng.random(n) < 0.15] = np.nan
        x[:7] = np.nan
        x[100:130] = 2.5
        parts.append(pd.DataFrame({"g": g, "date": pd.date_range("2020-01-01", periods=n).date, "x": x}))
    pdf = pd.concat(parts, ignore_index=True)
    rows = [(g, d, None if np.isnan(x) else float(x)) for g, d, x in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, date date, x double"), pdf


def check(df, name, want: pd.Series, pdf, tol=1e-9):
    got = df.select("g", "date", name).toPandas().sort_values(["g", "date"]).reset_index(drop=True)[name]
    np.testing.assert_allclose(got.astype(float).to_numpy(), want.reset_index(drop=True).to_numpy(dtype=float), rtol=tol, atol=tol)


@pytest.mark.parametrize("spans", [None, SPANS])
def test_rolling(spark, spans):
    df, pdf = make(spark)
    out = wn.rolling_stats(df, "x", 20, ("mean", "std", "count"), 5, by="g", spans=spans)
    roll = pdf.groupby("g")["x"].rolling(20, min_periods=5)
    check(out, "x_mean20", roll.mean(), pdf)
    check(out, "x_std20", roll.std(), pdf, 1e-6)
    out = wn.rolling_quantile(df, "x", 30, 0.7, by="g", min_periods=5, spans=spans)
    check(out, "x_q70_30", pdf.groupby("g")["x"].rolling(30, min_periods=5).quantile(0.7), pdf)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("spans", [None, SPANS])
def test_percent_rank(spark, ties, spans):
    df, pdf = make(spark, ties=ties)

    def rank(v):
        v = v[~np.isnan(v)]
        return 100.0 * (v <= v[-1]).sum() / len(v)

    want = pdf.groupby("g")["x"].rolling(25, min_periods=10).apply(rank, raw=True)
    check(wn.rolling_percent_rank(df, "x", 25, 10, by="g", spans=spans), "x_rank25", want, pdf)


@pytest.mark.parametrize("alpha", [0.05, 1 / 14, 0.5, 0.97])
@pytest.mark.parametrize("spans", [None, SPANS])
def test_ewm(spark, alpha, spans):
    # The high alphas pass several cuts of the closed form.
    df, pdf = make(spark)
    want = pdf.groupby("g")["x"].transform(lambda s: s.ewm(alpha=alpha, adjust=False).mean())
    check(wn.ewm(df, "x", alpha, by="g", spans=spans), "x_ewm", want, pdf)


@pytest.mark.parametrize("spans", [None, SPANS])
def test_fill_and_change(spark, spans):
    df, pdf = make(spark)
    want = pdf.groupby("g")["x"].transform(lambda s: s.ffill().bfill())
    check(wn.ffill_bfill(df, "x", by="g", spans=spans), "x", want, pdf)
    want = pdf.groupby("g")["x"].transform(lambda s: s.ffill().pct_change(3, fill_method=None))
    check(wn.returns(df, "x", 3, by="g", spans=spans), "x_pct3", want, pdf)
    want = pdf.groupby("g")["x"].transform(lambda s: s.rolling(5).sum().shift(-4))
    check(wn.forward_sum(df, "x", 5, by="g", spans=spans), "x_next5", want, pdf)


@pytest.mark.parametrize("spans", [None, SPANS])
def test_account(spark, spans):
    df, pdf = make(spark)
    small = df.withColumn("r", F.col("x") / 100.0)
    values = []
    for _, part in pdf.groupby("g"):
        balance, month = 500.0, None
        for d, x in zip(part["date"], part["x"], strict=True):
            if month is not None and (d.year, d.month) != month:
                balance += 40.0
            balance *= float(np.exp(0.0 if np.isnan(x) else x / 100.0))
            values.append(balance)
            month = (d.year, d.month)
    check(wn.account_nav(small, "r", 500.0, 40.0, by="g", spans=spans), "nav", pd.Series(values), pdf, 1e-10)


def test_drawdown_starts_at_first_value(spark):
    rows = [("a", f"2020-01-0{i + 1}", r) for i, r in enumerate([-0.1, 0.05, -0.2])]
    df = spark.createDataFrame(rows, "g string, date string, r double").withColumn("date", F.to_date("date"))
    out = [r["drawdown"] for r in wn.drawdown(df, "r", by="g").orderBy("date").collect()]
    np.testing.assert_allclose(out, [0.0, 0.0, np.exp(-0.2) - 1], atol=1e-12)


def test_positions_and_running(spark):
    df, pdf = make(spark)
    pos = with_position(df, "date", "g", "date_trunc('month', date)")
    check(pos, "_pos", pdf.groupby("g").cumcount(), pdf)
    total = running(df, {"t": ("sum", F.col("x")), "m": ("max", F.col("x"))}, "date", "g", SPANS)
    check(total, "t", pdf.groupby("g")["x"].transform(lambda s: s.cumsum().ffill()), pdf)
    check(total, "m", pdf.groupby("g")["x"].transform(lambda s: s.cummax().ffill()), pdf)


def test_scores_reject_unknown_options(spark):
    from moodloom.operators.indicators import to_greed_score

    df, _ = make(spark)
    with pytest.raises(ValueError):
        to_greed_score(df, "x", "panic")
    with pytest.raises(ValueError):
        to_greed_score(df, "x", "fear", method="other")
