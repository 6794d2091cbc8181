"""Market indicators, their 0-100 scores, and the merged daily table and features built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import clip, flag, names, number, ratio, steps
from .filters import drop_warmup
from .joining import left_merge, outer_chain
from .series import Order, Spans, over_frames, running
from .windows import ewm, forward_sum, lag_features, rolled, rolling_percent_rank, rolling_z_cdf


def to_greed_score(df: DataFrame, raw: str, higher_is: str, window: int = fv.TRADING_DAYS,
                   min_periods: int | None = None, method: str = "percentile", clip_z: float = 5.0,
                   name: str = "score", keep_warmup: bool = True, order: Order = "date", by: Order | None = None,
                   spans: Spans | None = None) -> DataFrame:
    """Turn a raw indicator into a 0-100 score over a rolling window. Fear indicators are negated first."""
    if higher_is not in ("greed", "fear"):
        raise ValueError("higher_is must be 'greed' or 'fear'")
    if method not in ("percentile", "z_cdf"):
        raise ValueError("method must be 'percentile' or 'z_cdf'")
    value = number(raw)
    aligned = df.withColumn("_aligned", value if higher_is == "greed" else -value)
    if method == "percentile":
        scored = rolling_percent_rank(aligned, "_aligned", window, min_periods, order, by, name, spans)
    else:
        scored = rolling_z_cdf(aligned, "_aligned", window, min_periods, clip_z, order, by, name, spans)
    return drop_warmup(scored.drop("_aligned"), name, keep_warmup)


def _score_options(score: Mapping, **defaults) -> dict:
    return {"keep_warmup": False, **defaults, **score}


def idx_momentum(df: DataFrame, close: str = "close", ma: int = 125, by: Order | None = None, order: Order = "date",
                 **score) -> DataFrame:
    """Distance of the close from its moving average."""
    priced = df.withColumn("close", number(close))
    raw = over_frames(priced, lambda w: {"ma125": rolled(F.avg, F.col("close"), w, ma)}, order, by, ma - 1)
    raw = raw.withColumn("momentum_raw", ratio(F.col("close"), F.col("ma125")) - 1.0)
    return to_greed_score(raw, "momentum_raw", "greed", name="Momentum_Score", order=order, by=by,
                          **_score_options(score)).select(
        *names(by), *names(order), "close", "ma125", "momentum_raw", "Momentum_Score")


def pad_ticker(ticker: str, width: int = 6) -> Column:
    """Left-pad with zeros; longer ids stay whole."""
    text = F.col(ticker).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def idx_strength(panel: DataFrame, ticker: str = "ticker", close: str = "close", n: int = 252, min_obs: int = 252,
                 by: Order | None = None, order: str = "date", **score) -> DataFrame:
    """New highs against new lows over all tickers with enough history, per date."""
    keys = names(by)
    rows = panel.select(*keys, F.col(order), pad_ticker(ticker).alias("_ticker"), number(close).alias("_close"))
    value = F.col("_close")

    def extremes(w):
        frame = w.rowsBetween(-(n - 1), 0)
        return {"_hi": F.max(value).over(frame), "_lo": F.min(value).over(frame), "_n": F.count(value).over(frame)}

    marked = over_frames(rows, extremes, order, [*keys, "_ticker"], n - 1)
    active = F.col("_n") >= min_obs
    daily = marked.groupBy(*keys, order).agg(
        F.count_if(active & flag(value >= F.col("_hi"))).alias("new_high"),
        F.count_if(active & flag(value <= F.col("_lo"))).alias("new_low"),
        F.count_if(active).alias("active_count"))
    daily = daily.withColumn("strength_raw", 100.0 * ratio(F.col("new_high") - F.col("new_low"), F.col("active_count")))
    return to_greed_score(daily, "strength_raw", "greed", name="Strength_Score", order=order, by=by,
                          **_score_options(score))


def idx_breadth(panel: DataFrame, ticker: str = "ticker", close: str = "close", value: str = "value",
                fast: float = 0.10, slow: float = 0.05, by: Order | None = None, order: str = "date",
                oscillator: str | None = None, **score) -> DataFrame:
    """Traded value of rising against falling tickers, smoothed fast and slow."""
    keys = names(by)
    options = _score_options(score, method="z_cdf")
    if oscillator:
        daily = panel.withColumn("oscillator", number(oscillator))
    else:
        rows = panel.select(*keys, F.col(order), pad_ticker(ticker).alias("_ticker"), number(close).alias("_close"),
                            number(value).alias("_value"))
        moved = over_frames(rows, lambda w: {"_before": F.lag("_close").over(w)}, order, [*keys, "_ticker"], 1)
        amount = F.coalesce("_value", F.lit(0.0))
        daily = moved.groupBy(*keys, order).agg(
            F.sum(F.when(flag(F.col("_close") > F.col("_before")), amount).otherwise(0.0)).alias("AV"),
            F.sum(F.when(flag(F.col("_close") < F.col("_before")), amount).otherwise(0.0)).alias("DV"))
        daily = daily.withColumn("net_value", F.col("AV") - F.col("DV"))
        daily = ewm(daily, "net_value", fast, order, by, "trend_fast")
        daily = ewm(daily, "net_value", slow, order, by, "trend_slow")
        daily = daily.withColumn("oscillator", F.col("trend_fast") - F.col("trend_slow"))
    return to_greed_score(daily, "oscillator", "greed", name="osc_score_0_100", order=order, by=by, **options)


def idx_putcall(df: DataFrame, put: str | None = None, call: str | None = None, ratio_col: str | None = None,
                by: Order | None = None, order: str = "date", **score) -> DataFrame:
    """Put volume against call volume; no call volume gives no value."""
    value = number(ratio_col) if ratio_col else ratio(number(put), number(call))
    raw = df.withColumn("put_call_ratio", value)
    return to_greed_score(raw, "put_call_ratio", "fear", name="score_pcr", order=order, by=by,
                          **_score_options(score)).select(*names(by), order, "put_call_ratio", "score_pcr")


def idx_volatility(df: DataFrame, vol: str, ma: int = 50, by: Order | None = None, order: str = "date",
                   **score) -> DataFrame:
    """Volatility against its moving average."""
    base = df.withColumn("volatility", number(vol))
    raw = over_frames(base, lambda w: {"vol_ma": rolled(F.avg, F.col("volatility"), w, ma)}, order, by, ma - 1)
    raw = raw.withColumn("vol_ratio", ratio(F.col("volatility"), F.col("vol_ma")))
    return to_greed_score(raw, "vol_ratio", "fear", name="Score_Fear", order=order, by=by,
                          **_score_options(score)).select(
        *names(by), order, "volatility", "vol_ma", "vol_ratio", "Score_Fear")


def idx_safe(df: DataFrame, stock: str = "stock", bond: str = "bond", n: int = 20, by: Order | None = None,
             order: str = "date", **score) -> DataFrame:
    """Bond return minus stock return over n rows."""
    base = df.withColumns({"_stock": number(stock), "_bond": number(bond)})
    raw = over_frames(base, lambda w: {
        "stock_ret_20d": ratio(F.col("_stock"), F.lag("_stock", n).over(w)) - 1.0,
        "bond_ret_20d": ratio(F.col("_bond"), F.lag("_bond", n).over(w)) - 1.0}, order, by, n)
    raw = raw.withColumn("safe_demand_raw", F.col("bond_ret_20d") - F.col("stock_ret_20d"))
    return to_greed_score(raw, "safe_demand_raw", "fear", name="score_safe_demand", order=order, by=by,
                          **_score_options(score)).select(
        *names(by), order, "stock_ret_20d", "bond_ret_20d", "safe_demand_raw", "score_safe_demand")


def idx_spread(df: DataFrame, kind: str = "BBB_GOV", spread_col: str | None = None, by: Order | None = None,
               order: str = "date", **score) -> DataFrame:
    """Credit spread of monthly rates."""
    pairs = {"AA_GOV": ("AA", "GOV3Y"), "BBB_GOV": ("BBB", "GOV3Y"), "BBB_AA": ("BBB", "AA")}
    if spread_col:
        value = number(spread_col)
    elif kind in pairs:
        high, low = pairs[kind]
        value = number(high) - number(low)
    else:
        raise ValueError(f"unknown spread kind: {kind}")
    raw = df.withColumn("junk_spread", value)
    rates = [c for c in ("GOV3Y", "BBB", "AA") if c in df.columns]
    return to_greed_score(raw, "junk_spread", "fear", name="Final_JunkIndex", order=order, by=by,
                          **_score_options(score, window=12)).select(
        *names(by), order, *rates, "junk_spread", "Final_JunkIndex")


def merge_daily(market: DataFrame, indices: Sequence[DataFrame], sentiment: DataFrame | None = None,
                patch_rows: DataFrame | None = None, close: str = "close", skip: int = 0, on: str = "date",
                by: Order | None = None) -> DataFrame:
    """Market rows with log returns, all sub-indices and daily sentiment; the target is the next return."""
    keys = names(by)
    first, *rest = indices
    if patch_rows is not None:
        first = first.unionByName(patch_rows, allowMissingColumns=True)
    table = outer_chain([first, *rest], [*keys, on])

    def log_return(w):
        share = ratio(F.col(close), F.lag(close).over(w))
        return {"log_return": F.ln(F.when(share > 0, share))}

    priced = over_frames(market, log_return, on, keys, 1).dropna()
    merged = left_merge(priced, table, on=[*keys, on])
    merged = over_frames(merged, lambda w: {"log_return_t+1": F.lead("log_return").over(w)}, on, keys, 0, 1)
    if sentiment is not None:
        merged = left_merge(merged, sentiment, on=[*keys, on])
    merged = merged.where(F.col("`log_return_t+1`").isNotNull())
    if not skip:
        return merged
    return over_frames(merged, lambda w: {"_r": F.row_number().over(w)}, on, keys).where(
        F.col("_r") > skip).drop("_r")


def rsi(df: DataFrame, column: str, n: int = 14, order: Order = "date", by: Order | None = None,
        name: str = "rsi14") -> DataFrame:
    """Relative strength index from exponentially weighted gains and losses."""
    moved = over_frames(df, lambda w: {"_d": F.col(column) - F.lag(column).over(w)}, order, by, 1)
    moved = moved.withColumns({"_gain": clip(F.col("_d"), lo=0.0), "_loss": clip(-F.col("_d"), lo=0.0)})
    smooth = ewm(ewm(moved, "_gain", 1 / n, order, by, "_g"), "_loss", 1 / n, order, by, "_l")
    return smooth.withColumn(name, 100 - 100 / (1 + F.col("_g") / (F.col("_l") + 1e-9))).drop(
        "_d", "_gain", "_loss", "_g", "_l")


def vol_features(df: DataFrame, vol: str = "egarch_vol", by: Order | None = None, order: Order = "date",
                 window: int = 60, q: float = 0.7) -> DataFrame:
    """Shock, high-volatility flag, five-row mean and trend flag of a volatility series."""
    padded = running(df, {"_pad": ("last", F.col(vol))}, order, by)

    def parts(w):
        v = F.col(vol)
        high = rolled(lambda c: F.percentile(c, F.lit(q)), v, w, window)
        mean = rolled(F.avg, v, w, 5)
        return {"vol_shock": clip(ratio(F.col("_pad"), F.lag("_pad").over(w)) - 1.0, -5.0, 5.0),
                "vol_regime_high": flag(v > high).cast("double"),
                "vol_ma5": mean, "vol_trend": flag(v > mean).cast("double")}

    return over_frames(padded, parts, order, by, window - 1).drop("_pad")


_FILL = ("sent_", "neg_z", "effective", "heat", "pos_", "weight")


def build_features(df: DataFrame, sent_ma: int = 10, by: Order | None = None, order: str = "date",
                   price: str = "close") -> DataFrame:
    """Features of the day before each row and the return targets after it.

    Needs sentiment columns, sub_index2..7, a price, `log_return_t+1` and the columns of `vol_features`.
    All feature columns, the price included, are shifted by one row so that none sees its own day.
    """
    keys = names(by)
    fill = [c for c in df.columns if any(part in c for part in _FILL)]
    filled = running(df, {f"_f_{c}": ("last", F.col(c)) for c in fill}, order, keys)
    d = filled.withColumns({c: F.col(f"_f_{c}") for c in fill}).drop(*[f"_f_{c}" for c in fill])
    d = d.withColumns({
        "neg_z_inv": -F.col("neg_z"), "sent_std_inv": -F.col("sent_std"),
        "sent_energy": F.col("sent_strength_w") * F.col("sent_norm_w")})
    d = d.withColumn("sent_composite",
                     F.col("sent_norm_w") * 0.4 + F.col("neg_z_inv") * 0.3 + F.col("sent_energy") * 0.3)
    p, vol = F.col(price), F.col("egarch_vol")
    # Relative change with missing prices padded first.
    d = running(d, {"_p": ("last", p)}, order, keys)

    def first_round(w):
        mean = {n: rolled(F.avg, p, w, n) for n in (5, 20, 60, 120)}
        lag1 = {f"sub_index{i}_lag1": F.lag(f"sub_index{i}").over(w) for i in range(2, 8)}
        return {
            "sent_norm_ma5": rolled(F.avg, F.col("sent_norm_w"), w, 5),
            "sent_norm_diff": F.col("sent_norm_w") - F.lag("sent_norm_w").over(w),
            "neg_z_ma5": rolled(F.avg, F.col("neg_z"), w, 5),
            "sent_composite_ma10": rolled(F.avg, F.col("sent_composite"), w, sent_ma),
            "sent_composite_diff": F.col("sent_composite") - F.lag("sent_composite", 5).over(w),
            "ma20": mean[20], "ma60": mean[60], "ma120": mean[120],
            "ma_ratio_5_20": mean[5] / (mean[20] + 1e-9) - 1,
            "ma_ratio_20_60": mean[20] / (mean[60] + 1e-9) - 1,
            "ma_ratio_60_120": mean[60] / (mean[120] + 1e-9) - 1,
            **{f"mom{n}": ratio(F.col("_p"), F.lag("_p", n).over(w)) - 1 for n in (5, 20, 60)},
            **{f"above_ma{n}": flag(p > mean[n]).cast("double") for n in (20, 60, 120)},
            "vol_ratio": vol / (rolled(F.avg, vol, w, 60) + 1e-9),
            **lag1,
            "egarch_vol_lag1": F.lag(vol).over(w), "egarch_vol_ma5_lag1": F.lag("vol_ma5").over(w),
            "vol_shock_lag1": F.lag("vol_shock").over(w), "vol_regime_lag1": F.lag("vol_regime_high").over(w),
        }

    d = over_frames(d, first_round, order, keys, 119)
    d = rsi(d, price, 14, order, keys)
    d = d.withColumns({
        "trend_strength": F.col("above_ma20") + F.col("above_ma60") + F.col("above_ma120"),
        "neg_z_vol_ratio": clip(F.col("neg_z_inv") / (F.col("egarch_vol_lag1") + 1e-6), -10.0, 10.0),
        "dayofweek": F.weekday(order).cast("double"), "month": F.month(order).cast("double"),
        "target_reg": F.col("`log_return_t+1`")}).drop("_p")
    d = forward_sum(d, "target_reg", 5, order, keys, "target_5d")
    d = d.withColumnRenamed("log_return_t+1", "next_return")
    features = [c for c in d.columns if c not in (*keys, order, "target_reg", "target_5d")]
    shifted = lag_features(d, features, 1, order, keys)
    return shifted.withColumnRenamed("next_return", "log_return_t+1")


def state_bucket(df: DataFrame, column: str, name: str = "state", colour: str | None = None) -> DataFrame:
    """Mood label of a 0-100 score; its colour on request."""
    value = F.col(column)
    out = {name: steps(value, fv.MOOD_STATES)}
    if colour:
        out[colour] = steps(value, fv.MOOD_COLOURS)
    return df.withColumns(out)
