"""Walk-forward volatility and index estimation, a static index, and boosted-tree comparisons.

Fits run in Spark tasks: one task per (series, block of dates) for the walk-forward index and volatility, and sums of products in the JVM for the
static ridge. A series holds one row per date, which bounds each group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions.columns import clip, names
from .boosting import Trees, fits
from .joining import by_block, expanding_blocks
from .series import ordered, over_frames, running
from .volatility import egarch_fits

PENALTIES = np.logspace(-2, 2, 10)


def log_returns(df: DataFrame, price: str, order: str = "date", by=None, name: str = "log_return") -> DataFrame:
    """Log return of a price; the first one counts as 0."""
    return over_frames(
        df, lambda w: {name: F.coalesce(F.ln(F.try_divide(F.col(price), F.lag(price).over(w))), F.lit(0.0))},
        order, by, 1)


def walk_forward_vol(df: DataFrame, ret: str, method: str = "std", min_obs: int = 60, order: str = "date", by=None,
                     name: str = "egarch_vol", diagnostics: bool = False) -> DataFrame:
    """Volatility of each row from earlier rows only, from row `min_obs` on.

    `std` is the deviation of the last 20 returns. `egarch` fits an exponential volatility recursion with skewed t
    innovations at every date (`volatility.egarch_fits`). `diagnostics` adds the likelihood of each date's fit and
    whether it converged, as `<name>_loglik` and `<name>_converged`.
    """
    keys = names(by)
    value = F.coalesce(F.col(ret), F.lit(0.0))
    if method == "std":
        def deviation(w):
            frame = w.rowsBetween(-20, -1)
            ready = (F.row_number().over(w) > min_obs) & (F.count(value).over(frame) == 20)
            return {name: F.when(ready, F.stddev_samp(value).over(frame))}

        return over_frames(df, deviation, order, keys)
    if method != "egarch":
        raise ValueError(f"unknown volatility method: {method}")
    wanted = {name: "sigma"} | ({f"{name}_{c}": c for c in ("loglik", "converged")} if diagnostics else {})
    found = egarch_fits(df, ret, min_obs, order, keys).select(*keys, order, *[F.col(c).alias(n) for n, c in wanted.items()])
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in [*keys, order]]
    return df.alias("_l").join(found.alias("_r"), same, "left").select("_l.*", *[F.col(f"_r.{n}") for n in wanted])


def ridge_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge coefficients with the penalty of least leave-one-out error (closed form for all penalties)."""
    xc, yc = x - x.mean(axis=0), y - y.mean()
    values, vectors = np.linalg.eigh(xc.T @ xc)
    u = xc @ vectors
    shrink = 1.0 / (np.maximum(values, 0.0)[:, None] + PENALTIES[None, :])
    loads = shrink * (u.T @ yc)[:, None]
    leverage = 1.0 / len(y) + (u * u) @ shrink
    errors = (yc[:, None] - u @ loads) / (1.0 - leverage)
    best = int(np.argmin((errors**2).mean(axis=0)))
    return vectors @ loads[:, best]


def signed_weights(x: np.ndarray, y: np.ndarray, signs: np.ndarray, start: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge through the origin with each coefficient held to its sign, by coordinate descent."""
    gram = x.T @ x + penalty * np.eye(x.shape[1])
    target, b = x.T @ y, start.copy()
    for _ in range(500):
        largest = 0.0
        for j in range(len(b)):
            new = b[j] + (target[j] - gram[j] @ b) / gram[j, j]
            new = max(new, 0.0) if signs[j] >= 0 else min(new, 0.0)
            largest = max(largest, abs(new - b[j]))
            b[j] = new
        if largest <= 1e-13 + 1e-10 * np.abs(b).max():
            break
    return b


def walk_forward_scores(df: DataFrame, feats: Sequence[str], directions: Sequence[int], target: str = "target_5d",
                        min_obs: int = 60, signed: bool = False, embargo: int = 0, order: str = "date", by=None,
                        block: int = 128) -> DataFrame:
    """Raw index value of each row from a ridge fitted on earlier rows of its series.

    The last labels before a row reach past it, as the target sums later returns; `embargo` leaves
    that many of the latest training rows out.
    """
    keys = names(by)
    feats, signs = list(feats), np.asarray(directions, dtype=float)
    slim = df.select(*keys, order, F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double") for f in feats])
    blocks = expanding_blocks(slim, order, min_obs, block, keys)
    schema = ", ".join([f"`{k}` {dict(df.dtypes)[k]}" for k in [*keys, order]] + ["raw_score double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        x, y = pdf[feats].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float)
        first = int(pdf["_block"].iloc[0]) * block
        known = ~np.isnan(x).any(axis=1)
        usable = known & ~np.isnan(y)
        dates, scores, warm = [], [], np.zeros(len(feats))
        for t in range(max(first, min_obs), min(first + block, len(pdf))):
            rows = usable[: max(t - embargo, 0)]
            xt, yt = x[: len(rows)][rows], y[: len(rows)][rows]
            if len(yt) < 30 or not known[t]:
                continue
            mean, std = xt.mean(axis=0), xt.std(axis=0)
            std[std < 10 * np.finfo(float).eps * np.maximum(1.0, np.abs(mean))] = 1.0
            scaled = np.clip((xt - mean) / std, -3, 3)
            if signed:
                coef = warm = signed_weights(scaled, yt, signs, warm)
            else:
                coef = ridge_weights(scaled, yt) * signs
            weights = coef / (np.abs(coef).sum() + 1e-12)
            dates.append(t)
            scores.append(float(np.clip((x[t] - mean) / std, -3, 3) @ weights))
        out = pdf[[*keys, order]].iloc[dates].copy()
        out["raw_score"] = scores
        return out

    return by_block(blocks, keys).applyInPandas(fit, schema)


def scale_between(raw: str, low: Column, high: Column) -> Column:
    inside = F.greatest(F.least(F.col(raw), high), low)
    return F.when(F.col(raw).isNotNull(), 100.0 * (inside - low) / (high - low + 1e-12))


def walk_forward_index(df: DataFrame, feats: Sequence[str], directions: Sequence[int], target: str = "target_5d",
                       min_obs: int = 60, signed: bool = False, embargo: int = 0, order: str = "date", by=None,
                       name: str = "index_score") -> DataFrame:
    """Walk-forward scores on a 0-100 scale between their 1st and 99th percentile.

    The scale uses the whole series by design; the raw scores do not look ahead. Rows without a
    score are left out.
    """
    keys = names(by)
    raw = walk_forward_scores(df, feats, directions, target, min_obs, signed, embargo, order, keys)
    whole = Window.partitionBy(*keys)
    scaled = raw.withColumn("_q", F.percentile("raw_score", F.array(F.lit(0.01), F.lit(0.99))).over(whole))
    scaled = scaled.withColumn(name, scale_between("raw_score", F.col("_q")[0], F.col("_q")[1])).drop("_q", "raw_score")
    return df.join(scaled, [*keys, order], "inner")


def ablation(feats: Sequence[str], drop_regex: str = fv.SENTIMENT_FEATURES) -> list[str]:
    """Feature list without the family the pattern names."""
    return [f for f in feats if not re.search(drop_regex, f)]


def index_features(columns: Sequence[str], features: Mapping[str, int] = fv.INDEX_FEATURES,
                   drop_regex: str | None = None) -> tuple[list[str], list[int]]:
    """Index features a table has, and their directions."""
    feats = [f for f in features if f in columns]
    if drop_regex:
        feats = ablation(feats, drop_regex)
    return feats, [features[f] for f in feats]


def static_index(df: DataFrame, feats: Sequence[str], target: str, cutoff: str, order: str = "date",
                 penalties: Sequence[float] = (0.1, 1.0, 10.0), name: str = "index_score") -> DataFrame:
    """Index from one ridge fitted up to a date, scaled between the training percentiles 1 and 99.

    Means, deviations and cross products are sums in the JVM; only a matrix of the number of
    features reaches the driver. The penalty is the one of least leave-one-out error, which a second
    pass over the training rows sums up.
    """
    feats = list(feats)
    is_train = F.col(order) <= F.lit(cutoff).cast(dict(df.dtypes)[order])
    train = df.where(is_train)
    moments = train.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("y"), *[
        e for i, f in enumerate(feats) for e in (F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}"))]).first()
    n = moments["n"]
    scale = [moments[f"s{i}"] or 1.0 for i in range(len(feats))]
    z = [(F.col(f) - moments[f"m{i}"]) / scale[i] for i, f in enumerate(feats)]
    y = F.col(target) - moments["y"]
    p = len(feats)
    sums = train.agg(
        *[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)],
        *[F.sum(z[i] * y).alias(f"c{i}") for i in range(p)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    cross = np.array([sums[f"c{i}"] for i in range(p)])
    values, vectors = np.linalg.eigh(gram)

    def combine(weights: np.ndarray) -> Column:
        total = F.lit(0.0)
        for part, weight in zip(z, weights, strict=True):
            total = total + part * float(weight)
        return total

    axes = train.select(y.alias("_y"), *[combine(vectors[:, k]).alias(f"u{k}") for k in range(p)])
    losses = []
    for penalty in penalties:
        shrink = 1.0 / (np.maximum(values, 0.0) + penalty)
        loads = shrink * (vectors.T @ cross)
        fitted, leverage = F.lit(0.0), F.lit(1.0 / n)
        for k in range(p):
            fitted = fitted + F.col(f"u{k}") * float(loads[k])
            leverage = leverage + F.col(f"u{k}") * F.col(f"u{k}") * float(shrink[k])
        losses.append(F.avg(F.pow((F.col("_y") - fitted) / (1.0 - leverage), F.lit(2.0))))
    errors = axes.agg(*[loss.alias(f"e{i}") for i, loss in enumerate(losses)]).first()
    penalty = penalties[int(np.argmin([errors[f"e{i}"] for i in range(len(penalties))]))]
    coef = vectors @ ((vectors.T @ cross) / (np.maximum(values, 0.0) + penalty))
    raw = df.withColumn("raw_score", combine(coef / np.abs(coef).sum()))
    low, high = raw.where(is_train).agg(F.percentile("raw_score", F.array(F.lit(0.01), F.lit(0.99)))).first()[0]
    inside = clip(F.col("raw_score"), low, high)
    return raw.withColumn(name, 100.0 * (inside - low) / (high - low)).drop("raw_score")


def gbt_compare(df: DataFrame, feature_sets: Mapping[str, Sequence[str]], targets: Mapping[str, str], cutoff: str,
                weight: str | None = None, next_return: str = "target_reg", order: str = "date", rounds: int = 300,
                step: float = 0.02, depth: int = 5, by=None) -> DataFrame:
    """Returns of trading on boosted-tree signals, per target kind (`reg` or `cls`) and feature set.

    All models are fitted side by side: each row goes to every (kind, feature set), whose number is fixed.
    """
    feats = list(dict.fromkeys(f for own in feature_sets.values() for f in own))
    is_train = F.col(order) <= F.lit(cutoff).cast(dict(df.dtypes)[order])
    cases = [(f"{kind}_{label}", kind, target, list(own)) for kind, target in targets.items() for label, own in feature_sets.items()]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(target).cast("double").alias("_y")) for name, _, target, _ in cases]))
    rows = df.withColumn("_case", each).withColumns({"model": F.col("_case.model"), "_y": F.col("_case._y"), "_next": F.col(next_return)})
    settings = {name: Trees(rounds, step, depth, loss="squared" if kind == "reg" else "logistic") for name, kind, _, _ in cases}
    scored = fits(rows, [*names(by), "model"], feats, "_y", order, is_train, settings, {name: own for name, _, _, own in cases}, "model", weight,
                  carry=["_next"], name="_pred")
    signal = F.col("_pred") > F.when(F.startswith("model", F.lit("reg_")), 0.0).otherwise(0.5)
    return scored.select(*names(by), "model", order, (signal.cast("double") * F.col("_next")).alias("strat_ret"))


def gbt_summary(traded: DataFrame) -> DataFrame:
    """Annual return and Sharpe ratio of each model's signal."""
    yearly = F.avg("strat_ret") * fv.TRADING_DAYS
    spread = F.stddev_samp("strat_ret") * math.sqrt(fv.TRADING_DAYS) + 1e-9
    return traded.groupBy("model").agg(yearly.alias("ann_ret"), (yearly / spread).alias("sharpe"),
                                       F.exp(F.sum("strat_ret")).alias("growth"), F.count(F.lit(1)).alias("n"))


def fold_ids(df: DataFrame, k: int = 5, order: str = "date", by=None) -> DataFrame:
    """Number of the test fold of each row in its series: the last k of k+1 blocks, earlier rows are 0."""
    series = Window.partitionBy(*names(by)) if by else Window.partitionBy(F.lit(0))
    numbered = df.withColumns({"_r": F.row_number().over(series.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(series)})
    size = F.expr(f"_n div {k + 1}")
    start = F.col("_n") - k * size
    fold = F.when((F.col("_r") >= start) & (size > 0), F.floor((F.col("_r") - start) / size) + 1).otherwise(0)
    return numbered.withColumn("fold", fold.cast("int")).drop("_r", "_n")


def _fold_models(df: DataFrame, feats: Sequence[str], target: str, k: int, order: str, by, models: Column) -> DataFrame:
    """Each row with the models that learn from it or are tested on it: `_model` is the fold a model is tested on."""
    whole = df.dropna(subset=[target, *feats])
    return fold_ids(whole, k, order, by).withColumn("_model", F.explode(models)).where(F.col("_model") >= F.col("fold"))


def ts_cv(df: DataFrame, feats: Sequence[str], target: str = "target_5d", k: int = 5, order: str = "date",
          rounds: int = 500, step: float = 0.02, depth: int = 5, by=None, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Expanding cross-validation of boosted trees, per series of `by`: errors (one row per fold, with mean and deviation over the
    folds) and out-of-fold predictions. Rows without a feature or the target are left out before the folds are cut."""
    keys = names(by)
    rows = _fold_models(df, feats, target, k, order, by, F.sequence(F.lit(1), F.lit(k)))
    predictions = fits(rows.withColumn("_y", F.col(target).cast("double")), [*keys, "_model"], feats, "_y", order, F.col("fold") < F.col("_model"),
                       Trees(rounds, step, depth, share), carry=[target], name="pred_5d").withColumnRenamed("_model", "fold")
    gap = F.col("pred_5d") - F.col(target)
    errors = predictions.groupBy(*keys, "fold").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    # One row per fold, so these windows hold k rows a series.
    folds = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    errors = errors.withColumns({"rmse_mean": F.avg("rmse").over(folds), "rmse_std": F.stddev_pop("rmse").over(folds)})
    return errors, predictions


def feature_importance(df: DataFrame, feats: Sequence[str], target: str = "target_5d", k: int = 5, order: str = "date", rounds: int = 500,
                       step: float = 0.02, depth: int = 5, by=None, share: float = 0.7, families: Mapping[str, str] = fv.FEATURE_FAMILIES,
                       other: str = "other") -> DataFrame:
    """Each feature's share of the gains in the last fold's model, its family and the family's share. Only that model is fitted."""
    keys = names(by)
    rows = _fold_models(df, feats, target, k, order, by, F.array(F.lit(k))).where(F.col("fold") < F.col("_model"))
    values = fits(rows.withColumn("_y", F.col(target).cast("double")), [*keys, "_model"], feats, "_y", order, F.lit(True),
                  Trees(rounds, step, depth, share), importance=True).drop("_model")
    family = None
    for label, pattern in families.items():
        hit = F.rlike("feature", F.lit(pattern))
        family = F.when(hit, label) if family is None else family.when(hit, label)
    # One row per feature: windows over a series hold as many.
    rows = values.withColumn("family", family.otherwise(other) if family is not None else F.lit(other))
    share_ = F.sum("importance").over(Window.partitionBy(*keys, "family"))
    return rows.withColumn("family_share", F.try_divide(share_, F.sum("importance").over(Window.partitionBy(*keys or [F.lit(0)]))))


def exp_growth(df: DataFrame, ret: str, order: str = "date", by=None) -> DataFrame:
    """Cumulative growth of log returns."""
    return running(df, {"_s": ("sum", F.col(ret))}, order, by).withColumn("growth", F.exp("_s")).drop("_s")
