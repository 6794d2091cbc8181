"""Regimes, exposure, strategy returns, performance and account figures."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions.columns import clip, flag, lookup, names, ratio
from ..session import settle
from .aggregates import with_grid
from .falls import max_drawdown
from .joining import bounded_join, null_safe_join
from .ranks import with_quantiles
from .series import Spans, over_frames, running
from .windows import account_nav, drawdown


def regime(df: DataFrame, score: str = "index_score", name: str = "regime") -> DataFrame:
    """bull, crisis or normal, from the index, the volatility state and the trend."""
    bull = (F.col(score) > 65) & (F.col("vol_regime_high") == 0) & (F.col("trend_strength") >= 2)
    crisis = flag(F.col(score) < 25) | flag(F.col("vol_shock") > fv.VOL_SHOCK_LIMIT)
    return df.withColumn(name, F.when(flag(bull), "bull").when(crisis, "crisis").otherwise("normal"))


def trend_weight(strength: Column) -> Column:
    return lookup(strength.cast("int"), fv.TREND_WEIGHT, 0.0)


def vol_position(vol: Column) -> Column:
    return clip(F.sqrt(F.lit(fv.TARGET_DAILY_VOL) / (vol + 1e-9)), fv.MIN_LEVERAGE, fv.MAX_LEVERAGE)


def index_multiplier(score: Column, low: Column, high: Column, momentum: bool = True) -> Column:
    share = score / 100.0 * (high - low)
    value = low + share if momentum else high - share
    return F.when(score.isNotNull(), F.greatest(F.least(value, high), low))


def position_size(momentum: bool, score: str, bounds: Sequence[float | Column],
                  regime_weights: Mapping[str, float | Column], shock_limit: float = fv.VOL_SHOCK_LIMIT,
                  loss_limit: float = fv.TAIL_LOSS_LIMIT) -> Column:
    """Position size of a row that already has `cumret_3d`; bounds and weights may be fields of a grid point."""
    as_column = [b if isinstance(b, Column) else F.lit(float(b)) for b in bounds]
    by_regime = None
    for label, value in regime_weights.items():
        literal = value if isinstance(value, Column) else F.lit(float(value))
        hit = F.col("regime") == label
        by_regime = F.when(hit, literal) if by_regime is None else by_regime.when(hit, literal)
    size = (trend_weight(F.col("trend_strength")) * vol_position(F.col("egarch_vol"))
            * index_multiplier(F.col(score), *as_column, momentum) * by_regime)
    broken = flag(F.col("vol_shock") > shock_limit) | (F.col("cumret_3d") < loss_limit)
    return F.when(broken, 0.0).otherwise(clip(size, 0.0, fv.MAX_LEVERAGE * 1.5))


def recent_return(df: DataFrame, ret: str = "target_reg", order: str = "date", by=None,
                  spans: Spans | None = None) -> DataFrame:
    """Add `cumret_3d`, the return over the three rows before; 0 unless all three are known."""
    def recent(w):
        frame = w.rowsBetween(-3, -1)
        return {"cumret_3d": F.when(F.count(ret).over(frame) == 3, F.sum(ret).over(frame)).otherwise(0.0)}

    return over_frames(df, recent, order, by, 3, 0, spans)


def exposure(df: DataFrame, momentum: bool = True, score: str = "index_score", ret: str = "target_reg",
             order: str = "date", by=None, bounds: tuple = fv.MULTIPLIER_RANGE,
             regime_weights: Mapping[str, float | Column] | None = None, name: str = "weight",
             shock_limit: float = fv.VOL_SHOCK_LIMIT, loss_limit: float = fv.TAIL_LOSS_LIMIT,
             spans: Spans | None = None) -> DataFrame:
    """Position size: trend weight x volatility target x index multiplier x regime multiplier.

    A volatility shock, or a loss over the three rows before, closes the position. `bounds` and the
    regime weights may be columns, so that a parameter grid runs in one plan.
    """
    weights = fv.REGIME_MULTIPLIER if regime_weights is None else regime_weights
    d = recent_return(df, ret, order, by, spans)
    return d.withColumn(name, position_size(momentum, score, bounds, weights, shock_limit, loss_limit))


def strategy_return(df: DataFrame, weight: str = "weight", ret: str = "target_reg", fee: float | Column = fv.FEE,
                    order: str = "date", by=None, name: str = "strat_ret", spans: Spans | None = None) -> DataFrame:
    """Return of the position of the row before, net of the cost of changing it."""
    cost = fee if isinstance(fee, Column) else F.lit(float(fee))

    def net(w):
        held = F.coalesce(F.lag(weight, 1).over(w), F.lit(0.0))
        before = F.coalesce(F.lag(weight, 2).over(w), F.lit(0.0))
        return {"weight_lag": held, "turnover": F.abs(held - before)}

    d = over_frames(df, net, order, by, 2, 0, spans)
    return d.withColumn(name, F.col("weight_lag") * F.col(ret) - F.col("turnover") * cost)


def bench_returns(df: DataFrame, kind: str = "trend", ret: str = "target_reg", fee: float = fv.FEE,
                  order: str = "date", by=None) -> DataFrame:
    """Benchmarks: the market itself, the trend weight alone, or trend with a volatility target."""
    if kind == "hold":
        return df.withColumns({"weight": F.lit(1.0), "strat_ret": F.col(ret)})
    size = trend_weight(F.col("trend_strength"))
    if kind == "trend_vol":
        sized = clip(size * vol_position(F.col("egarch_vol")), 0.0, fv.MAX_LEVERAGE)
        size = F.when(flag(F.col("vol_shock") > fv.VOL_SHOCK_LIMIT), 0.0).otherwise(sized)
    elif kind != "trend":
        raise ValueError(f"unknown benchmark: {kind}")
    return strategy_return(df.withColumn("weight", size), "weight", ret, fee, order, by)


def perf_metrics(df: DataFrame, ret: str = "strat_ret", ref: str | None = "target_reg", order: str = "date",
                 by=None, spans: Spans | None = None) -> DataFrame:
    """Return, risk and drawdown figures of each series of log returns.

    With `spans` no task holds a series: the deepest fall is merged from records of blocks, the tail quantile comes
    from `ranks`, and everything else is a plain aggregate. Only the block expression of the spans is used.
    """
    keys = names(by)
    year = fv.TRADING_DAYS
    value = F.col(ret)
    if spans is None:
        rows = drawdown(df, ret, order, keys)
        rows = rows.withColumn("_q", F.percentile(ret, F.lit(0.05)).over(Window.partitionBy(*keys)))
    else:
        settled = settle(df)
        rows = with_quantiles(settled, ret, {"_q": 0.05}, keys).withColumn("drawdown", F.lit(None).cast("double"))
    down = flag(F.col(ref) < 0) if ref else F.lit(False)
    figures = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), (F.avg(value) * year).alias("ann_ret"),
        (F.stddev_samp(value) * math.sqrt(year) + 1e-9).alias("ann_vol"), F.min("drawdown").alias("mdd"),
        (F.exp(F.sum(value)) - 1).alias("total_return"),
        F.avg(F.when(value <= F.col("_q"), value)).alias("cvar5"),
        (F.stddev_samp(F.when(down, value)) * math.sqrt(year)).alias("downside_vol"),
        F.avg(F.when(down, value)).alias("_down"),
        (F.avg(F.when(down, F.col(ref))) if ref else F.lit(None).cast("double")).alias("_ref_down"))
    if spans is not None:
        falls = max_drawdown(settled, ret, order, keys, spans.block).select(*keys, F.col("mdd").alias("_mdd"))
        fallen = null_safe_join(figures, falls, keys, "left") if keys else figures.withColumn(
            "_mdd", falls.select("_mdd").scalar())
        figures = fallen.withColumn("mdd", F.col("_mdd")).drop("_mdd")
    return figures.withColumns({
        "sharpe": F.col("ann_ret") / F.col("ann_vol"),
        "calmar": F.col("ann_ret") / (F.abs("mdd") + 1e-9),
        "downday_defense": ratio(F.col("_down"), F.col("_ref_down") + 1e-9),
    }).drop("_down", "_ref_down")


Strategy = Callable[[DataFrame, list[str]], DataFrame]


def default_strategy(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exposure and net return, given the series keys."""
    return strategy_return(exposure(df, by=by), by=by)


def fee_stress(df: DataFrame, fees: Sequence[float] = tuple(fv.FEE_GRID), weight: str = "weight",
               ret: str = "target_reg", order: str = "date", by=None) -> DataFrame:
    """Performance under several fees; positions and turnover are computed once, only the cost differs."""
    moved = strategy_return(df, weight, ret, 0.0, order, by)
    priced = with_grid(moved, [{"fee": fee} for fee in fees]).withColumn(
        "strat_ret", F.col("weight_lag") * F.col(ret) - F.col("turnover") * F.col("fee"))
    return perf_metrics(priced, "strat_ret", ret, order, [*names(by), "fee"])


def perf_by_year(df: DataFrame, min_rows: int = 50, strategy: Strategy = default_strategy, ret: str = "target_reg",
                 order: str = "date", by=None) -> DataFrame:
    """Performance per calendar year; positions start anew in each year, short years are left out."""
    keys = [*names(by), "year"]
    yearly = df.withColumn("year", F.year(order))
    sized = yearly.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    full = sized.where(F.col("_rows") >= min_rows).drop("_rows")
    return perf_metrics(strategy(full, keys), "strat_ret", ret, order, keys)


def perf_oos(df: DataFrame, first: int = 2, min_rows: int = 50, strategy: Strategy = default_strategy,
             ret: str = "target_reg", order: str = "date", by=None) -> DataFrame:
    """Performance of each year that has at least `first` earlier ones."""
    keys = names(by)
    years = df.select(*keys, F.year(order).alias("year")).distinct()
    ranked = years.withColumn("train_years", F.row_number().over(Window.partitionBy(*keys).orderBy("year")) - 1)
    figures = perf_by_year(df, min_rows, strategy, ret, order, keys)
    return figures.join(ranked.where(F.col("train_years") >= first), [*keys, "year"], "inner")


def account_stats(wide: DataFrame, strategies: Sequence[str], capital: float, monthly: float = 0.0,
                  order: str = "date", baseline: str | None = None, by=None) -> DataFrame:
    """Account figures of several strategies held as columns of log returns, for each series.

    A strategy without any return keeps its capital: value and contribution are the capital, all other figures 0.
    """
    groups = names(by)
    keys = [*groups, "strategy"]
    long = wide.select(*groups, order, F.explode(F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.col(s).cast("double").alias("_ret")) for s in strategies])).alias("_s"))
    long = long.select(*groups, order, "_s.*")
    nav = account_nav(long, "_ret", capital, monthly, order, keys)
    peaked = running(nav, {"_peak": ("max", F.col("nav"))}, order, keys)
    figures = peaked.withColumn("_fall", F.col("nav") / F.col("_peak") - 1).groupBy(*keys).agg(
        F.max_by("nav", order).alias("final_value"), F.max_by("contributed", order).alias("contributed"),
        F.count("_ret").alias("n"), F.sum("_ret").alias("_sum"),
        (F.stddev_pop("_ret") * math.sqrt(fv.TRADING_DAYS)).alias("ann_vol"), F.min("_fall").alias("mdd"))
    some = F.col("n") > 0
    figures = figures.withColumns({c: F.when(some, F.col(c)).otherwise(F.lit(float(other))) for c, other in (
        ("final_value", capital), ("contributed", capital), ("ann_vol", 0.0), ("mdd", 0.0), ("_sum", 0.0))})
    years = F.greatest(F.col("n") / fv.TRADING_DAYS, F.lit(1.0 / fv.TRADING_DAYS))
    figures = figures.withColumns({
        "profit": F.col("final_value") - F.col("contributed"),
        "total_return": F.col("final_value") / F.col("contributed") - 1,
        "ann_ret": F.exp(F.col("_sum") / years) - 1}).drop("_sum")
    figures = figures.withColumn("sharpe", F.coalesce(ratio(F.col("ann_ret"), F.col("ann_vol")), F.lit(0.0)))
    if baseline is None:
        return figures
    held = figures.where(F.col("strategy") == baseline)
    if not groups:
        return figures.withColumn("delta_vs_baseline", F.col("final_value") - held.select("final_value").scalar())
    base = held.select(*groups, F.col("final_value").alias("_held"))
    return bounded_join(figures, base, groups, "left").withColumn(
        "delta_vs_baseline", F.col("final_value") - F.col("_held")).drop("_held")


def compare_with_market(figures: DataFrame, baseline: DataFrame, on: Sequence[str]) -> DataFrame:
    """Strategy figures next to those of a benchmark."""
    renamed = baseline.select(*on, *[F.col(c).alias(f"base_{c}") for c in ("ann_ret", "sharpe", "mdd")])
    return bounded_join(figures, renamed, list(on), "left")
