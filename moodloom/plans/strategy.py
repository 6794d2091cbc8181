"""From the merged daily table to strategy figures, and the end-to-end sensitivity runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import grid, names
from ..operators.classify import weight_of
from ..operators.indicators import build_features, vol_features
from ..operators.aggregates import daily_sentiment
from ..operators.joining import swap_columns
from ..operators.models import index_features, log_returns, walk_forward_index, walk_forward_vol
from ..operators.risk import exposure, perf_metrics, regime, strategy_return
from ..session import settle

SENTIMENT = ["sent_norm_w", "sent_strength_w", "sent_std", "neg_z", "effective_n", "heat"]


def prepare(daily: DataFrame, price: str = "close", sent_ma: int = 10, by=None, method: str = "std") -> DataFrame:
    """Volatility from earlier returns and the lagged feature table."""
    keys = names(by)
    table = log_returns(daily, price, "date", keys, "_r")
    table = walk_forward_vol(table, "_r", method, by=keys).drop("_r")
    return build_features(vol_features(table, by=keys), sent_ma, keys, price=price)


def index_and_exposure(features: DataFrame, signed: bool = False, by=None, drop_regex: str | None = None,
                       momentum: bool = True) -> DataFrame:
    """Walk-forward index, regime, exposure and net returns. The fitted index is kept once."""
    keys = names(by)
    feats, directions = index_features(features.columns, drop_regex=drop_regex)
    scored = settle(walk_forward_index(features, feats, directions, signed=signed, by=keys))
    return strategy_return(exposure(regime(scored), momentum, by=keys), by=keys)


def sweep_pipeline(daily: DataFrame, comments: DataFrame, gammas: Sequence[float] = tuple(fv.STRATEGY_GAMMA_GRID),
                   windows: Sequence[int] = tuple(fv.SENTIMENT_WINDOW_GRID), *, base_gamma: float = 2.0,
                   base_window: int = 10, ts: str = "comment_at", tz: str | None = fv.LOCAL_ZONE,
                   score: str = "toxicity_score", price: str = "close", method: str = "std") -> DataFrame:
    """Whole runs for several weight exponents and sentiment windows, all in one job.

    The grid point is a series key, so the runs share every shuffle. Windows only change one rolling
    mean; each distinct length is built once.
    """
    exponents = sorted({*gammas, base_gamma})
    gridded = comments.withColumn("_g", F.explode(grid([{"gamma": float(g)} for g in exponents]))).withColumn(
        "gamma", F.col("_g.gamma")).withColumn("_w", weight_of(F.col(score), F.col("gamma")))
    sentiment = daily_sentiment(gridded, ts, "p_pos", None, "p_neg", "_w", tz, by="gamma")
    spread = daily.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in exponents])))
    swapped = settle(swap_columns(spread, sentiment.select("gamma", "date", *SENTIMENT), SENTIMENT, "date", "gamma"))
    runs = None
    for length in sorted({*windows, base_window}):
        part = prepare(swapped, price, length, "gamma", method).withColumn("sent_ma", F.lit(length))
        keep = F.lit(False)
        if length == base_window:
            keep = keep | F.col("gamma").isin([float(g) for g in gammas])
        if length in windows:
            keep = keep | (F.col("gamma") == base_gamma)
        runs = part.where(keep) if runs is None else runs.unionByName(part.where(keep))
    keys = ["gamma", "sent_ma"]
    figures = perf_metrics(index_and_exposure(runs, True, keys), by=keys)
    cells = []
    if gammas:
        cells.append(F.when((F.col("sent_ma") == base_window) & F.col("gamma").isin([float(g) for g in gammas]),
                            F.struct(F.lit("gamma").alias("experiment"), F.col("gamma").alias("param"))))
    if windows:
        cells.append(F.when((F.col("gamma") == base_gamma) & F.col("sent_ma").isin(list(windows)),
                            F.struct(F.lit("sent_ma").alias("experiment"), F.col("sent_ma").cast("double").alias("param"))))
    rows = figures.withColumn("_e", F.explode(F.array_compact(F.array(*cells))))
    return rows.select("_e.*", *[c for c in figures.columns if c not in keys])

