"""Tests of significance: t-tests from aggregated moments and a bootstrap run by Spark."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import names
from .ranks import with_quantiles


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if not 0.0 < x < 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total / a


@F.pandas_udf(T.DoubleType())
def two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t. Runs on one row per test, after the aggregates."""
    return pd.Series([
        None if pd.isna(tv) or pd.isna(dv) or dv <= 0 else _beta_tail(dv / 2.0, 0.5, dv / (dv + tv * tv))
        for tv, dv in zip(t, dof, strict=True)], dtype="float64")


def ttest_1samp(df: DataFrame, column: str, cond: Column | None = None, by=None) -> DataFrame:
    """Is the mean 0, over all rows or those that meet a condition."""
    return ttests_1samp(df, column, {"": cond}, by)


def ttests_1samp(df: DataFrame, column: str, conds: Mapping[str, Column | None], by=None) -> DataFrame:
    """Several such tests in one aggregate; the name of each is the ending of its columns."""
    values = {end: F.col(column) if cond is None else F.when(cond, F.col(column)) for end, cond in conds.items()}
    out = df.groupBy(*names(by)).agg(*[call(v).alias(f"{name}{end}") for end, v in values.items() for name, call in (
        ("n", F.count), ("mean", F.avg), ("std", F.stddev_samp))])
    for end in values:
        t = F.try_divide(F.col(f"mean{end}"), F.col(f"std{end}") / F.sqrt(f"n{end}"))
        out = out.withColumn(f"t_stat{end}", t).withColumn(
            f"p_value{end}", two_sided_p(f"t_stat{end}", (F.col(f"n{end}") - 1).cast("double")))
    return out


def ttest_welch(df: DataFrame, column: str, score: str, lo: float = 0.25, hi: float = 0.75, by=None) -> DataFrame:
    """Do rows of high and of low score differ in mean (unequal variances)."""
    keys = names(by)
    marked = with_quantiles(df, score, {"_lo": lo, "_hi": hi}, keys)
    low = F.when(F.col(score) <= F.col("_lo"), F.col(column))
    high = F.when(F.col(score) >= F.col("_hi"), F.col(column))
    moments = marked.groupBy(*keys).agg(*[
        call(value).alias(f"{name}_{side}") for side, value in (("high", high), ("low", low))
        for name, call in (("n", F.count), ("mean", F.avg), ("_var", F.var_samp))])
    a, b = F.col("_var_high") / F.col("n_high"), F.col("_var_low") / F.col("n_low")
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n_high") - 1) + b * b / (F.col("n_low") - 1))
    tested = moments.withColumn(
        "t_stat", F.try_divide(F.col("mean_high") - F.col("mean_low"), F.sqrt(a + b))).withColumn("dof", dof)
    return tested.withColumn("p_value", two_sided_p("t_stat", "dof")).drop("_var_high", "_var_low")


def drawn(seed: int, rep: int, n: int) -> np.ndarray:
    """How often each of n rows is drawn in a replicate: by md5 digits, so that every run and engine draws the same."""
    picks = [int(hashlib.md5(f"{seed}|{rep}|{i}".encode()).hexdigest()[:13], 16) % n for i in range(n)]
    return np.bincount(picks, minlength=n).astype(float)


def weighted_spearman(times: np.ndarray, x: tuple[np.ndarray, int], y: tuple[np.ndarray, int]) -> float | None:
    """Rank correlation of rows that count `times` each; a variable is its rows' places among its distinct values."""
    ranks = []
    for place, size in (x, y):
        here = np.bincount(place, times, minlength=size)
        ranks.append((np.cumsum(here) - (here - 1) / 2)[place])
    gaps = [r - (times * r).sum() / times.sum() for r in ranks]
    spread = float((times * gaps[0] ** 2).sum() * (times * gaps[1] ** 2).sum())
    return float((times * gaps[0] * gaps[1]).sum()) / math.sqrt(spread) if spread > 0 else None


def bootstrap_spearman(df: DataFrame, a: str, b: str, y: str, n: int = 1000, seed: int = 42, order: str = "date",
                       by=None, chunk: int = 50) -> DataFrame:
    """Does `a` follow `y` in rank more than `b` does: difference of the correlations, resampled n times per series.

    A daily series has one row per date, so it fits one row as arrays; chunks of replicates run in parallel on it. The
    values are ranked once: a replicate only counts how often each place was drawn.
    """
    keys = names(by)
    cols = [F.col(c).cast("double").alias(f"_{k}") for k, c in (("a", a), ("b", b), ("y", y))]
    clean = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()).select(*keys, order, *cols)
    packed = clean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "_a", "_b", "_y"))).alias("_s"))
    packed = packed.select(*keys, *[F.col(f"_s.{k}").alias(k) for k in ("_a", "_b", "_y")])
    starts = list(range(0, n + 1, chunk))
    jobs = packed.withColumn("_from", F.explode(F.array(*[F.lit(i) for i in starts]))).repartition(len(starts), *keys, "_from")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields if f.name in keys)

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for row in table.to_dict("records"):
                places = {}
                for k in ("_a", "_b", "_y"):
                    values, place = np.unique(np.asarray(row[k], float), return_inverse=True)
                    places[k] = (place, len(values))
                size, out = len(row["_y"]), []
                for rep in range(row["_from"], min(row["_from"] + chunk, n + 1)):
                    times = drawn(seed, rep, size) if rep else np.ones(size)
                    out.append({**{k: row[k] for k in keys}, "rep": rep, "rho_a": weighted_spearman(times, places["_a"], places["_y"]),
                                "rho_b": weighted_spearman(times, places["_b"], places["_y"])})
                yield pd.DataFrame(out).astype({"rho_a": "float64", "rho_b": "float64"})

    rho = jobs.mapInPandas(run, f"{kept}{', ' if kept else ''}rep long, rho_a double, rho_b double")
    gap = F.col("rho_a") - F.col("rho_b")
    real, resampled = F.col("rep") == 0, F.col("rep") > 0
    return rho.groupBy(*keys).agg(
        F.max(F.when(real, F.col("rho_a"))).alias("rho_a"), F.max(F.when(real, F.col("rho_b"))).alias("rho_b"),
        F.max(F.when(real, gap)).alias("rho_diff"),
        F.avg(F.when(resampled, (gap <= 0).cast("double"))).alias("p_value"),
        F.avg(F.when(resampled, gap)).alias("boot_mean"), F.count_if(resampled).alias("replicates"))
