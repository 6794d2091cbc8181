"""Merged records of falls against the plain window and a loop; grids as arrays against one run per point."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodloom.functions import fixed_values as fv
from moodloom.operators import falls as fa
from moodloom.operators import risk as rs
from moodloom.operators import sweeps as sw
from moodloom.operators import windows as wn
from moodloom.operators.series import Spans


def frame(spark, n=300, seed=5, groups=("a", "b", None)):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        for i in range(n):
            r = None if rng.random() < 0.2 or i < 3 else float(rng.normal(0.0, 0.02))
            rows.append((g, i, r, float(rng.normal(0.0, 0.02))))
    return spark.createDataFrame(rows, "g string, at int, r double, ref double")


def deepest(values):
    level, peak, fall = 0.0, None, 0.0
    for v in values:
        level += v
        peak = level if peak is None else max(peak, level)
        fall = min(fall, level - peak)
    return np.exp(fall) - 1


@pytest.mark.parametrize("blocks", ["0", "at", "at div 7", ["at div 3", "block div 5", "block div 4"]])
def test_any_blocks_give_the_fall_of_the_whole(spark, blocks):
    df = frame(spark)
    got = {r["g"]: (r["rows"], r["mdd"]) for r in fa.max_drawdown(df, "r", "at", "g", blocks).collect()}
    assert len(got) == 3
    for g in ("a", "b", None):
        values = [r["r"] for r in df.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("at").collect() if r["r"] is not None]
        assert got[g][0] == len(values)
        np.testing.assert_allclose(got[g][1], deepest(values), atol=1e-12)


def test_falls_equal_the_window(spark):
    df = frame(spark, seed=9)
    want = {r["g"]: r["m"] for r in wn.drawdown(df, "r", "at", "g").groupBy("g").agg(F.min("drawdown").alias("m")).collect()}
    got = {r["g"]: r["mdd"] for r in fa.max_drawdown(df, "r", "at", "g", "at div 11").collect()}
    for g, m in want.items():
        np.testing.assert_allclose(got[g], m, atol=1e-12)


def test_edges(spark):
    schema = "g string, at int, r double"
    empty = spark.createDataFrame([], schema)
    assert fa.max_drawdown(empty, "r", "at", "g", "at div 2").count() == 0
    unknown = spark.createDataFrame([("a", 1, None), ("b", 1, 0.5)], schema)
    assert [tuple(r) for r in fa.max_drawdown(unknown, "r", "at", "g", "at div 2").collect()] == [("b", 1, 0.0)]
    # Only rises: no fall; only falls: from the first value, not from the level before it.
    rise = spark.createDataFrame([("a", i, 0.1) for i in range(9)] + [("b", i, -0.1) for i in range(9)], schema)
    got = {r["g"]: r["mdd"] for r in fa.max_drawdown(rise, "r", "at", "g", "at div 2").collect()}
    np.testing.assert_allclose([got["a"], got["b"]], [0.0, np.exp(-0.8) - 1], atol=1e-12)


@pytest.mark.parametrize("by", ["g", None])
def test_figures_without_whole_series(spark, by):
    df = frame(spark) if by else frame(spark, groups=("a",)).drop("g")
    plain = rs.perf_metrics(df, "r", "ref", "at", by)
    spans = rs.perf_metrics(df, "r", "ref", "at", by, Spans("at div 30"))
    assert plain.columns == spans.columns
    def keyed(d):
        return sorted(([str(r[by]) if by else ""] + [float(r[c]) for c in plain.columns if c != by] for r in d.collect()))
    for a, b in zip(keyed(plain), keyed(spans), strict=True):
        assert a[0] == b[0]
        np.testing.assert_allclose(a[1:], b[1:], rtol=1e-9, atol=1e-12)


def market(spark, n=120):
    rng = np.random.default_rng(2)
    rows = [(g, i, None if i % 17 == 3 else float(rng.uniform(0, 100)), float(rng.normal(0, 0.03)), int(rng.integers(0, 4)),
             None if i % 23 == 5 else float(rng.uniform(0.001, 0.03)), float(rng.uniform(0.5, 2.4)),
             str(rng.choice(["bull", "normal", "crisis"]))) for g in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "g string, date int, index_score double, target_reg double, trend_strength int, "
                                       "egarch_vol double, vol_shock double, regime string")


def test_grid_equals_one_run_per_point(spark):
    df = market(spark)
    points = sw.exposure_grid(fv.MULTIPLIER_GRID[:2], fv.REGIME_GRID[:2])
    swept = {(r["g"], r["k_min"], r["k_max"], r["bull"], r["crisis"]): r for r in sw.sweep_exposure(df, points, by="g").collect()}
    assert len(swept) == 2 * len(points)
    for p in points:
        sized = rs.exposure(df, by="g", bounds=(p["k_min"], p["k_max"]), regime_weights={c: p[c] for c in ("bull", "normal", "crisis")})
        for r in rs.perf_metrics(rs.strategy_return(sized, by="g"), by="g").collect():
            other = swept[r["g"], p["k_min"], p["k_max"], p["bull"], p["crisis"]]
            for c in ("n", "ann_ret", "ann_vol", "mdd", "cvar5", "sharpe", "downside_vol"):
                np.testing.assert_allclose(other[c], r[c], rtol=1e-12, err_msg=c)


def test_grid_is_shuffled_once(spark):
    df = market(spark)

    def shuffles(points):
        plan = sw.sweep_exposure(df, points, by="g")._jdf.queryExecution().executedPlan().toString()
        return plan.split("Generate explode")[0].count("Exchange"), plan.split("Generate explode")[-1].count("Exchange")

    # Rows are dealt by series below the explode; nothing is dealt again above it.
    assert shuffles(sw.exposure_grid()) == shuffles(sw.exposure_grid()[:1]) == (0, 1)
