"""Window and time-series operators. Frames count rows, not days, and each takes optional series keys.

Every operator also takes `spans` (see `series`) so that a series too long for one task is cut
into spans with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.columns import clip, flag, names, normal_cdf, ratio
from ..functions.fixed_values import EPS
from .joining import bounded_join
from .series import Order, Spans, ordered, over_frames, running, with_position
from .sliding import over_sorted_frames

# Longer frames are kept sorted while they slide (`sliding`); shorter ones are listed anew at each row. Results are equal.
LONG_FRAME = 512


def back(window: WindowSpec, n: int) -> WindowSpec:
    """Frame of the current row and the n-1 rows before it."""
    return window.rowsBetween(-(n - 1), 0)


def rolled(call, value: Column, window: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Aggregate over the last n rows; NULL until enough of them are present."""
    frame = back(window, n)
    needed = n if min_periods is None else min_periods
    return F.when(F.count(value).over(frame) >= max(needed, 1), call(value).over(frame))


def lags(df: DataFrame, cols: str | Sequence[str], n: int = 1, order: Order = "date", by: Order | None = None,
         spans: Spans | None = None) -> DataFrame:
    """Value n rows earlier; a negative n looks ahead."""
    suffix = f"lag{n}" if n >= 0 else f"lead{-n}"
    return over_frames(df, lambda w: {f"{c}_{suffix}": F.lag(c, n).over(w) for c in names(cols)},
                       order, by, max(n, 0), max(-n, 0), spans)


def returns(df: DataFrame, column: str, n: int = 1, kind: str = "pct", pad: bool = True, order: Order = "date",
            by: Order | None = None, name: str | None = None, spans: Spans | None = None) -> DataFrame:
    """Change over n rows: `diff`, `pct` (missing values padded first unless pad is off) or `log`."""
    out = name or f"{column}_{kind}{n}"
    source, result = column, df
    if kind == "pct" and pad:
        source = "_padded"
        result = running(df, {source: ("last", F.col(column))}, order, by, spans)

    def change(w: WindowSpec) -> dict[str, Column]:
        now, then = F.col(source), F.lag(source, n).over(w)
        if kind == "diff":
            return {out: now - then}
        share = ratio(now, then)
        return {out: share - 1 if kind == "pct" else F.ln(F.when(share > 0, share))}

    if kind not in ("diff", "pct", "log"):
        raise ValueError(f"unknown kind of return: {kind}")
    result = over_frames(result, change, order, by, n, 0, spans)
    return result.drop("_padded")


def ffill_bfill(df: DataFrame, cols: str | Sequence[str], order: Order = "date", by: Order | None = None,
                backward: bool = True, spans: Spans | None = None) -> DataFrame:
    """Carry the last known value forward and, if asked, fill the start from the first known value."""
    cols = names(cols)
    filled = running(df, {f"_f_{c}": ("last", F.col(c)) for c in cols}, order, by, spans)
    if backward:
        # What a forward fill leaves empty lies before the first known value of the series.
        keys = names(by)
        key = names(order)[0]
        if spans is None:
            whole = Window.partitionBy(*keys)
            firsts = {f"_b_{c}": F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).over(whole) for c in cols}
            filled = filled.withColumns(firsts)
        else:
            firsts = df.groupBy(*keys).agg(
                *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_b_{c}") for c in cols])
            filled = filled.join(firsts, keys, "left") if keys else filled.withColumns(
                {f"_b_{c}": firsts.select(f"_b_{c}").scalar() for c in cols})
        filled = filled.withColumns({f"_f_{c}": F.coalesce(f"_f_{c}", f"_b_{c}") for c in cols}).drop(
            *[f"_b_{c}" for c in cols])
    return filled.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


_ROLLING = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}


def rolling_stats(df: DataFrame, column: str, n: int, funcs: Sequence[str] = ("mean", "std"),
                  min_periods: int | None = None, order: Order = "date", by: Order | None = None,
                  spans: Spans | None = None) -> DataFrame:
    """Statistics of the last n rows, NULL while fewer than min_periods values are known."""
    def stats(w: WindowSpec) -> dict[str, Column]:
        return {f"{column}_{f}{n}": rolled(_ROLLING[f], F.col(column), w, n, min_periods) for f in funcs}

    return over_frames(df, stats, order, by, n - 1, 0, spans)


def rolling_quantile(df: DataFrame, column: str, n: int, q: float, order: Order = "date", by: Order | None = None,
                     min_periods: int | None = None, name: str | None = None,
                     spans: Spans | None = None, long_frame: int = LONG_FRAME) -> DataFrame:
    """Quantile of the last n rows with linear interpolation."""
    out = name or f"{column}_q{int(round(q * 100))}_{n}"
    if n > long_frame:
        return over_sorted_frames(df, column, n, n if min_periods is None else min_periods, out, q, order, by, spans)
    return over_frames(
        df, lambda w: {out: rolled(lambda c: F.percentile(c, F.lit(q)), F.col(column), w, n, min_periods)},
        order, by, n - 1, 0, spans)


def _ranked(known: Column, needed: int) -> Column:
    """Share of the listed values that do not exceed the last one, in percent."""
    below = F.size(F.filter(known, lambda v: v <= F.element_at(known, -1)))
    return F.when(F.size(known) >= max(needed, 1), 100.0 * below / F.size(known))


def rolling_percent_rank(df: DataFrame, column: str, n: int = 252, min_periods: int | None = None,
                         order: Order = "date", by: Order | None = None, name: str | None = None,
                         spans: Spans | None = None, long_frame: int = LONG_FRAME) -> DataFrame:
    """Share of the known values of the last n rows that do not exceed the last known one, in percent.

    The values of a short frame are listed once per row and counted in the next step: used inside one
    expression, every mention of the list would be a window of its own.
    """
    if n > long_frame:
        return over_sorted_frames(df, column, n, n if min_periods is None else min_periods, name or f"{column}_rank{n}",
                                  None, order, by, spans)
    listed = over_frames(df, lambda w: {"_known": F.collect_list(column).over(back(w, n))}, order, by, n - 1, 0, spans)
    score = _ranked(F.col("_known"), n if min_periods is None else min_periods)
    return listed.withColumn(name or f"{column}_rank{n}", score).drop("_known")


def rolling_z_cdf(df: DataFrame, column: str, n: int = 252, min_periods: int | None = None, clip_z: float = 5.0,
                  order: Order = "date", by: Order | None = None, name: str | None = None,
                  spans: Spans | None = None) -> DataFrame:
    """Rolling z-score, bounded, through the normal distribution function, in percent."""
    x = F.col(column)
    moments = over_frames(
        df, lambda w: {"_mean": rolled(F.avg, x, w, n, min_periods), "_std": rolled(F.stddev_samp, x, w, n, min_periods)},
        order, by, n - 1, 0, spans)
    bounded = moments.withColumn("_z", ratio(x - F.col("_mean"), F.col("_std"))).withColumn(
        "_z", clip(F.col("_z"), -clip_z, clip_z))
    return bounded.withColumn(name or f"{column}_cdf{n}", normal_cdf(F.col("_z")) * 100.0).drop("_mean", "_std", "_z")


def ewm(df: DataFrame, column: str, alpha: float, order: Order = "date", by: Order | None = None,
        name: str | None = None, spans: Spans | None = None) -> DataFrame:
    """Exponentially weighted mean, y(t) = (1-alpha) y(t-1) + alpha x(t), started at the first value.

    Missing values repeat the last result while its weight keeps decaying. The recurrence has the
    closed form y(t) = sum of b(i) exp(S(i) - S(t)) with S the running sum of the log decays, which
    two running sums evaluate. To stay inside the range of a double the series is cut where S passes
    multiples of 300; across one whole cut a weight falls by e^-300, so only the previous part counts.
    """
    out = name or f"{column}_ewm"
    keys = names(by)
    if alpha >= 1:
        return running(df, {out: ("last", F.col(column))}, order, keys, spans)
    limit = 300.0
    x = F.col(column)
    if spans is None:
        numbered = df.withColumn("_at", F.row_number().over(ordered(order, keys)))
    else:
        numbered = with_position(df, order, keys, spans.block, "_at")
        spans = replace(spans, position="_at")
    seen = running(numbered, {"_seen": ("last", F.when(x.isNotNull(), F.col("_at")), -1)}, order, keys, spans)
    faded = F.pow(F.lit(1.0 - alpha), (F.col("_at") - F.col("_seen")).cast("double"))
    first = F.col("_seen").isNull()
    step = F.when(x.isNull() | first, 0.0).otherwise(
        F.least(-(F.lit(math.log(1.0 - alpha)) * (F.col("_at") - F.col("_seen"))) + F.ln(faded + alpha),
                F.lit(2 * limit)))
    gain = F.when(x.isNotNull(), F.when(first, x).otherwise(alpha * x / (faded + alpha)))
    summed = running(seen.withColumn("_step", step).withColumn("_gain", gain),
                     {"_s": ("sum", F.col("_step"))}, order, keys, spans)
    part = F.floor(F.col("_s") / limit)
    # Missing rows carry no weight; long runs of them are spread over parts of their own.
    gap = F.lit(0) if spans is None else F.floor(F.col("_at") / spans.rows)
    cut = summed.withColumn("_part", part).withColumn("_gap", F.when(x.isNull(), gap + 1).otherwise(0)).withColumn(
        "_u", F.col("_gain") * F.exp(F.col("_s") - F.col("_part") * limit))
    inside = Window.partitionBy(*keys, "_part", "_gap").orderBy(*names(order))
    cut = cut.withColumn("_sum", F.sum("_u").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    if spans is None:
        previous = Window.partitionBy(*keys).orderBy("_part").rangeBetween(-1, -1)
        carried = cut.withColumn("_prev", F.sum("_u").over(previous))
    else:
        totals = cut.where(x.isNotNull()).groupBy(*keys, (F.col("_part") + 1).alias("_part")).agg(
            F.sum("_u").alias("_prev"))
        carried = cut.join(totals, [*keys, "_part"], "left")
    y = F.col("_sum") * F.exp(F.col("_part") * limit - F.col("_s"))
    carry = F.coalesce(F.col("_prev"), F.lit(0.0)) * F.exp((F.col("_part") - 1) * limit - F.col("_s"))
    valued = carried.withColumn("_y", F.when(x.isNotNull(), y + carry))
    return running(valued, {out: ("last", F.col("_y"))}, order, keys, spans).drop(
        "_at", "_seen", "_step", "_gain", "_s", "_part", "_gap", "_u", "_sum", "_prev", "_y")


def rolling_z(df: DataFrame, column: str, n: int = 60, min_periods: int = 20, order: Order = "date",
              by: Order | None = None, name: str | None = None, spans: Spans | None = None) -> DataFrame:
    """Distance from the rolling mean in rolling standard deviations."""
    def score(w: WindowSpec) -> dict[str, Column]:
        mean = rolled(F.avg, F.col(column), w, n, min_periods)
        std = rolled(F.stddev_samp, F.col(column), w, n, min_periods)
        return {name or f"{column}_z": (F.col(column) - mean) / (std + EPS)}

    return over_frames(df, score, order, by, n - 1, 0, spans)


def heat(df: DataFrame, strength: str = "sent_strength_w", volume: str = "log_effective_n",
         by: Order | None = None, name: str = "heat") -> DataFrame:
    """Product of two whole-series z-scores. It looks at the whole series, later rows included."""
    keys, cols = names(by), (strength, volume)
    moments = df.groupBy(*keys).agg(*[call(c).alias(f"_{kind}{i}") for i, c in enumerate(cols)
                                      for kind, call in (("m", F.avg), ("s", F.stddev_samp))])
    if keys:
        joined = bounded_join(df, moments, keys, "left")
    else:
        whole = moments.select(F.struct("*").alias("_w"))
        joined = df.withColumn("_w", whole.scalar()).select("*", "_w.*").drop("_w")

    def z(i: int) -> Column:
        return (F.col(cols[i]) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + EPS)

    return joined.withColumn(name, z(0) * z(1)).drop("_m0", "_s0", "_m1", "_s1")


def forward_sum(df: DataFrame, column: str, n: int = 5, order: Order = "date", by: Order | None = None,
                name: str | None = None, spans: Spans | None = None) -> DataFrame:
    """Sum of the current and the next n-1 values, NULL unless all n are known."""
    def total(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(0, n - 1)
        known = F.count(column).over(frame) == n
        return {name or f"{column}_next{n}": F.when(known, F.sum(column).over(frame))}

    return over_frames(df, total, order, by, 0, n - 1, spans)


def lag_features(df: DataFrame, cols: Sequence[str], n: int = 1, order: Order = "date", by: Order | None = None,
                 spans: Spans | None = None) -> DataFrame:
    """Shift whole columns by n rows, then keep only rows without any missing value."""
    shifted = over_frames(df, lambda w: {f"_s_{c}": F.lag(c, n).over(w) for c in cols}, order, by, n, 0, spans)
    chosen = set(cols)
    moved = shifted.select(*[F.col(f"_s_{c}").alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])
    # One test per column: a single test over all of them multiplies with every later renaming when
    # the optimizer derives constraints.
    return moved.where(reduce(and_, [F.col(f"`{c}`").isNotNull() for c in df.columns]))


def drawdown(df: DataFrame, ret: str, order: Order = "date", by: Order | None = None,
             spans: Spans | None = None) -> DataFrame:
    """Growth of one unit from log returns, its running peak and the fall from the peak."""
    total = running(df, {"_total": ("sum", F.col(ret))}, order, by, spans)
    grown = total.withColumn("growth", F.when(F.col(ret).isNotNull(), F.exp("_total"))).drop("_total")
    peaked = running(grown, {"peak": ("max", F.col("growth"))}, order, by, spans)
    return peaked.withColumn("drawdown", F.col("growth") / F.col("peak") - 1)


def account_nav(df: DataFrame, ret: str, capital: float, monthly: float = 0.0, order: str = "date",
                by: Order | None = None, spans: Spans | None = None) -> DataFrame:
    """Balance of an account that earns log returns and is paid into at each change of month.

    The payment arrives before the return of the first row of a new month. With S the running sum of
    returns the balance is e^S (capital + sum of payments times e^-S before them), so no loop is needed.
    """
    month = F.trunc(F.col(order), "month")
    earned = F.coalesce(F.col(ret), F.lit(0.0))

    def paid(w: WindowSpec) -> dict[str, Column]:
        earlier = F.lag(month).over(w)
        return {"_pay": F.when(flag(month != earlier), F.lit(float(monthly))).otherwise(0.0)}

    marked = over_frames(df, paid, order, by, 1, 0, spans)
    summed = running(marked, {"_s": ("sum", earned), "_before": ("sum", earned, -1)}, order, by, spans)
    worth = F.col("_pay") * F.exp(-F.coalesce(F.col("_before"), F.lit(0.0)))
    total = running(summed, {"_paid": ("sum", worth), "_added": ("sum", F.col("_pay"))}, order, by, spans)
    return (
        total.withColumn("nav", F.exp("_s") * (capital + F.col("_paid")))
        .withColumn("contributed", capital + F.col("_added"))
        .drop("_pay", "_s", "_before", "_paid", "_added")
    )


def topk_per_group(df: DataFrame, by: Order, order: str, key: str, k: int, tie: Order | None = None,
                   rank: str = "rank") -> DataFrame:
    """The k largest distinct keys of each group, ranked from 1.

    Duplicates of a key collapse in a partial aggregate. Ranking then runs in two rounds, first
    inside slices of the group, so a hot group sends k rows per slice to its last task.
    """
    groups, ties = names(by), names(tie)
    rest = [c for c in df.columns if c not in (*groups, key)]
    # Of a repeated key: the largest value (a number, date or time), then the smallest ties and the rest, of any type.
    kind = dict(df.dtypes)[order]
    value = F.unix_date(order) if kind == "date" else F.unix_micros(order) if kind == "timestamp" else F.col(order)
    best = F.struct(F.col(order).isNull().alias("_none"), (-value).alias("_down"), *[F.col(c) for c in ties],
                    *[F.col(c) for c in rest if c not in ties])
    single = df.groupBy(*groups, key).agg(F.min(best).alias("_best"))
    single = single.select(*groups, key, *[F.col(f"_best.{c}").alias(c) for c in rest])
    by_rank = [F.desc(order), *[F.asc(t) for t in ties], F.asc(key)]
    sliced = single.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(64)))
    first = sliced.withColumn("_r", F.row_number().over(
        Window.partitionBy(*groups, "_slice").orderBy(*by_rank))).where(F.col("_r") <= k)
    ranked = first.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*by_rank)))
    return ranked.where(F.col(rank) <= k).drop("_slice", "_r")


def last_n(df: DataFrame, n: int, order: Order = "date", by: Order | None = None) -> DataFrame:
    """The last n rows of each series. The window group limit keeps only n rows per task before the shuffle."""
    latest = Window.partitionBy(*names(by)).orderBy(*[F.desc(o) for o in names(order)])
    return df.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n).drop("_r")


def calendar_parts(df: DataFrame, column: str = "date") -> DataFrame:
    """Day of week (Monday is 0), month and year."""
    day = F.col(column)
    return df.withColumns({"dayofweek": F.weekday(day), "month": F.month(day), "year": F.year(day)})
