"""Fitted volatility against a plain recursion, a fine grid and simulated series."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from moodloom.operators import models as md
from moodloom.operators import volatility as vol


def simulated(n, seed=3, alpha=0.2, beta=0.95, tail=6):
    rng = np.random.default_rng(seed)
    h, r = 0.0, np.empty(n)
    for t in range(n):
        z = rng.standard_t(tail) * math.sqrt((tail - 2) / tail)
        r[t] = 0.03 + math.exp(h / 2) * z
        h = beta * h + alpha * (abs(z) - vol.MEAN_ABS)
    return r / 100


def plain(r, before, mu, omega, alpha, beta, eta, lam):
    """Log likelihood and next log variance, one row at a time, density written out from its definition."""
    c = math.exp(math.lgamma((eta + 1) / 2) - math.lgamma(eta / 2)) / math.sqrt(math.pi * (eta - 2))
    a = 4 * lam * c * (eta - 2) / (eta - 1)
    b = math.sqrt(1 + 3 * lam * lam - a * a)
    h, total = omega + beta * before, 0.0
    for x in r:
        h = min(max(h, before - 15), before + 15)
        z = (x - mu) / math.exp(h / 2)
        side = 1 - lam if z < -a / b else 1 + lam
        total += math.log(b * c * (1 + ((b * z + a) / side) ** 2 / (eta - 2)) ** (-(eta + 1) / 2)) - h / 2
        h = omega + alpha * (abs(z) - math.sqrt(2 / math.pi)) + beta * h
    return total, min(max(h, before - 15), before + 15)


def test_density_is_standardised():
    z = np.linspace(-400, 400, 4_000_001)[:, None]
    for eta, lam in ((5.0, -0.4), (8.0, 0.0), (40.0, 0.7)):
        p = np.exp(vol.log_density(z.copy(), np.array([eta]), np.array([lam])))[:, 0]
        step = z[1, 0] - z[0, 0]
        assert abs(p.sum() * step - 1) < 1e-4
        assert abs((p * z[:, 0]).sum() * step) < 1e-3
        assert abs((p * z[:, 0] ** 2).sum() * step - 1) < 5e-3


def frame(spark, columns):
    parts = [pd.DataFrame({"series": name, "date": pd.date_range("2020-01-01", periods=len(r)).date, "lr": r})
             for name, r in columns.items()]
    return spark.createDataFrame(pd.concat(parts))


def test_fits_equal_plain_recursion_and_beat_a_grid(spark):
    r = simulated(300)
    found = vol.egarch_fits(frame(spark, {"a": r}), "lr", by="series", block=64).orderBy("date").toPandas()
    assert len(found) == 240 and found["converged"].all()
    before = vol.first_variance(r[:60] * 100)
    for t in (60, 97, 128, 211, 299):
        row = found.iloc[t - 60]
        total, ahead = plain(r[:t] * 100, before, *[row[p] for p in vol.PARAMS])
        assert abs(total - row["loglik"]) < 1e-6 and abs(math.exp(ahead / 2) / 100 - row["sigma"]) < 1e-9
        level = math.log((r[:t] * 100).var())
        for a, b, e, s, m in itertools.product((0.05, 0.1, 0.2, 0.3), (0.5, 0.9, 0.95, 0.98), (4, 8, 20), (-0.1, 0, 0.1),
                                               (level - 0.3, level, level + 0.3)):
            point = ((r[:t] * 100).mean(), (1 - b) * m, a, b, e, s)
            assert plain(r[:t] * 100, before, *point)[0] <= row["loglik"] + 1e-6


def test_long_series_gives_back_its_parameters():
    last = vol.fit_dates(simulated(3000) * 100, 2999, 3000, 60).iloc[-1]
    assert last["converged"]
    assert abs(last["alpha"] - 0.2) < 0.08 and abs(last["beta"] - 0.95) < 0.04 and 4.5 < last["eta"] < 9


def test_later_rows_change_nothing_earlier(spark):
    r = simulated(200, seed=5)
    other = r.copy()
    other[150:] *= -7
    both = vol.egarch_fits(frame(spark, {"a": r, "b": other}), "lr", by="series", block=64)
    wide = both.groupBy("date").pivot("series", ["a", "b"]).agg(F.first("sigma")).orderBy("date").toPandas()
    # The forecast of row 150 still reads rows before it only.
    assert np.allclose(wide["a"][:91], wide["b"][:91], rtol=1e-6) and not np.allclose(wide["a"][92:], wide["b"][92:])


def test_edges(spark):
    r = simulated(70, seed=8)
    gaps = r.copy()
    gaps[10] = np.nan
    df = frame(spark, {"flat": np.zeros(70), "short": r[:60], "gaps": gaps}).withColumn(
        "lr", F.when(~F.isnan("lr"), F.col("lr")))
    rows = vol.egarch_fits(df, "lr", by="series").toPandas()
    flat = rows[rows["series"] == "flat"]
    assert len(flat) == 10 and flat["sigma"].isna().all() and not flat["converged"].any()
    assert "short" not in set(rows["series"]) and rows[rows["series"] == "gaps"]["sigma"].notna().all()
    joined = md.walk_forward_vol(df, "lr", "egarch", by="series").toPandas()
    assert len(joined) == 200 and joined["egarch_vol"].notna().sum() == 10
    assert list(joined.columns) == [*df.columns, "egarch_vol"]
    told = md.walk_forward_vol(df, "lr", "egarch", by="series", diagnostics=True).where("series = 'flat'").toPandas()
    assert (told["egarch_vol_converged"] == False).sum() == 10 and told["egarch_vol_loglik"].isna().all()  # noqa: E712
    assert vol.egarch_fits(df.limit(0), "lr", by="series").count() == 0
