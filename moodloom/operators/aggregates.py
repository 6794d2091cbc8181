"""Aggregates: daily sentiment, stage summaries, corpus statistics and distribution profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.columns import clip, grid, local_date, names, number, ratio
from .classify import assign_topic, sentiment_norm
from .joining import bounded_join
from .ranks import quantiles
from .series import Order
from .windows import heat, rolling_z


def daily_aggregate(df: DataFrame, ts: str, pos: str, neu: str | None, neg: str, weight: str | None = None,
                    tz: str | None = fv.LOCAL_ZONE, key: str | None = None,
                    by: str | Sequence[str] | None = None) -> DataFrame:
    """Per local date: counts, weight sums, plain and weighted means. One shuffle of partial sums."""
    p, n = F.col(pos), F.col(neg)
    w = F.lit(1.0) if weight is None else clip(F.coalesce(number(weight), F.lit(1.0)), 0.0)
    rows = df.withColumn("date", local_date(ts, tz)).where(F.col("date").isNotNull())
    raw, norm = p - n, sentiment_norm(p, n)
    total = F.sum(w) + fv.EPS
    weighted = {"sent_raw_mean_w": raw, "sent_norm_w": norm, "pos_mean_w": p, "neg_mean_w": n}
    middle = [F.avg(neu).alias("p_neu_mean")] if neu else []
    daily = rows.groupBy(*names(by), "date").agg(
        F.count(F.col(key) if key else F.lit(1)).alias("comment_count"),
        F.sum(w).alias("weight_sum"), F.sum(w * w).alias("weight_sq_sum"),
        F.avg(raw).alias("sent_raw_mean"), F.avg(norm).alias("sent_norm_mean"),
        F.stddev_samp(raw).alias("sent_std"), F.avg(p).alias("p_pos_mean"), *middle, F.avg(n).alias("p_neg_mean"),
        *[(F.sum(value * w) / total).alias(name) for name, value in weighted.items()])
    size = F.col("weight_sum") * F.col("weight_sum") / (F.col("weight_sq_sum") + fv.EPS)
    return daily.withColumns({
        "sent_strength_w": F.col("pos_mean_w") + F.col("neg_mean_w"), "neg_score": F.col("neg_mean_w"),
        "effective_n": size, "log_effective_n": F.log1p(size)})


def daily_sentiment(df: DataFrame, ts: str, pos: str, neu: str | None, neg: str, weight: str | None = None,
                    tz: str | None = fv.LOCAL_ZONE, key: str | None = None,
                    by: str | Sequence[str] | None = None) -> DataFrame:
    """Daily aggregate with the rolling z-score of negativity and the heat of the series."""
    daily = daily_aggregate(df, ts, pos, neu, neg, weight, tz, key, by)
    daily = rolling_z(daily, "neg_score", 60, 20, "date", by, "neg_z")
    return heat(daily, by=by).where(F.col("sent_norm_w").isNotNull())


def stage_summary(df: DataFrame, flags: Mapping[str, Column] | Sequence[str], by: str | Sequence[str] | None = None,
                  means: Mapping[str, Column] | None = None, medians: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows, and per flag the rows that carry it and their share in percent; means and medians on request.

    Medians are meant for scores of few distinct values: the aggregate keeps one counter per value.
    """
    conditions = flags if isinstance(flags, Mapping) else {f: F.col(f) for f in flags}
    parts = [F.count(F.lit(1)).alias("total")]
    for name, condition in conditions.items():
        parts.append(F.count_if(condition).alias(name))
        parts.append((100.0 * F.count_if(condition) / F.count(F.lit(1))).alias(f"{name}_pct"))
    parts += [F.avg(value).alias(name) for name, value in (means or {}).items()]
    parts += [F.median(value).alias(name) for name, value in (medians or {}).items()]
    return df.groupBy(*names(by)).agg(*parts)


def label_counts(df: DataFrame, label: str, by: str | Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(*names(by), label).agg(F.count(F.lit(1)).alias("n"))


def top_keywords(df: DataFrame, array_col: str, n: int = 10, by: str | Sequence[str] | None = None,
                 unknown: str = "unknown") -> DataFrame:
    """Most frequent items of a list column (or of a text column, '' counted as unknown) per group."""
    keys = names(by)
    if dict(df.dtypes)[array_col].startswith("array"):
        rows = df.select(*keys, F.explode(array_col).alias("item"))
    else:
        rows = df.select(*keys, F.when(F.col(array_col) == "", unknown).otherwise(F.col(array_col)).alias("item"))
    counted = rows.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return counted.orderBy(F.desc("n"), "item").limit(n)
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("item"))
    return counted.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).drop("_r")


def funnel(df: DataFrame, stages: Mapping[str, Column], by: str) -> DataFrame:
    """Rows left after each stage per group and over all groups, with removed and retained shares.

    Stages are nested: a row passes a stage if it met it and every earlier one. Groups and grand
    total come from one rollup; the stages become rows afterwards, on the small result.
    """
    met, reached = [], F.lit(True)
    for condition in stages.values():
        reached = reached & F.coalesce(condition, F.lit(False))
        met.append(reached)
    counted = df.rollup(by).agg(
        F.grouping(by).alias("is_total"), F.count(F.lit(1)).alias("_raw"),
        *[F.count_if(m).alias(f"_s{i}") for i, m in enumerate(met)])
    cells = []
    for i, label in enumerate(stages):
        before = F.col("_raw") if i == 0 else F.col(f"_s{i - 1}")
        passed = F.col(f"_s{i}")
        cells.append(F.struct(
            F.lit(i + 1).alias("step"), F.lit(label).alias("stage"), before.alias("entered"), passed.alias("passed"),
            (before - passed).alias("removed"), ratio(100.0 * (before - passed), before).alias("removed_pct"),
            ratio(100.0 * passed, F.col("_raw")).alias("retained_pct")))
    rows = counted.select(by, F.col("is_total").cast("int").alias("is_total"), F.explode(F.array(*cells)).alias("_c"))
    return rows.select(by, "is_total", "_c.*")


def corpus_stats(df: DataFrame, by: str | Sequence[str], text: str = "text_raw", article: str = "news_id") -> DataFrame:
    """Rows, rows with text, distinct articles, share of empty rows and rows per article."""
    filled = tx.has_text(text)
    return df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(filled).alias("non_empty"),
        F.count_distinct(F.col(article)).alias("n_articles"),
    ).withColumns({
        "empty_rate": 100.0 * (F.col("raw") - F.col("non_empty")) / F.col("raw"),
        "rows_per_article": F.col("non_empty") / F.greatest("n_articles", F.lit(1))})


def band_of(value: Column, edges: Sequence[float]) -> Column:
    branches = None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        inside = (value >= lo) & (value < hi)
        branches = F.when(inside, lo) if branches is None else branches.when(inside, lo)
    return branches


def band_counts(df: DataFrame, column: str, edges: Sequence[float] = tuple(fv.BAND_EDGES), samples: int = 4,
                text: str | None = None, key: str | None = None) -> DataFrame:
    """Rows per band of values, with the texts of its lowest values as samples.

    Samples are picked in two rounds so that a crowded band does not pass through one task.
    """
    banded = df.withColumn("band", band_of(F.col(column), edges)).where(F.col("band").isNotNull())
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    if text is None:
        return counts
    order = [F.asc(column), F.asc(key or text)]
    slices = banded.select("band", column, text, *([key] if key else [])).withColumn(
        "_slice", F.pmod(F.xxhash64(key or text), F.lit(256)))
    few = slices.withColumn("_r", F.row_number().over(Window.partitionBy("band", "_slice").orderBy(*order))).where(
        F.col("_r") <= samples)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("band").orderBy(*order))).where(
        F.col("_r") <= samples)
    texts = few.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("_r", text))).alias("_t")).select(
        "band", F.transform("_t", lambda s: s[text]).alias("samples"))
    return counts.join(texts, "band", "left")


def tail_mass(df: DataFrame, column: str, weight: str | Column, cuts: Sequence[float] = tuple(fv.MASS_CUTS)) -> DataFrame:
    """Share of the weight, in percent, that lies at or above each cut. One pass for all cuts."""
    w = F.col(weight) if isinstance(weight, str) else weight
    sums = df.agg(F.sum(w).alias("_all"), *[
        F.sum(F.when(F.col(column) >= cut, w).otherwise(0.0)).alias(f"_c{i}") for i, cut in enumerate(cuts)])
    cells = F.array(*[F.struct(F.lit(float(cut)).alias("cut"), (100.0 * F.col(f"_c{i}") / F.col("_all")).alias("pct"))
                      for i, cut in enumerate(cuts)])
    return sums.select(F.explode(cells).alias("_c")).select("_c.*")


def exceed_by_year(df: DataFrame, column: str, cut: float = fv.HARD_TAU, by: str | Sequence[str] = "year") -> DataFrame:
    """Share of values at or above a cut, in percent, and the number of rows per group."""
    return df.groupBy(*names(by)).agg(
        (100.0 * F.avg((F.col(column) >= cut).cast("double"))).alias("pct"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, lo: float = -1.0, hi: float = 1.0, bins: int = 79,
              by: str | Sequence[str] | None = None) -> DataFrame:
    """Counts in equal bins; the last one is closed. Values outside the range are not counted."""
    value = F.col(column)
    place = F.least(F.floor((value - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    return df.where(value.between(lo, hi)).groupBy(*names(by), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage_gap(expected: DataFrame, collected: DataFrame, key: str, total: str = "comment_total_all",
                 limit: int | None = None) -> DataFrame:
    """Keys that have fewer collected rows than expected, largest gap first.

    Collected rows are counted per key before the join, so the join reads one row per key.
    """
    have = collected.groupBy(key).agg(F.count(F.lit(1)).alias("collected"))
    joined = expected.withColumn("expected", F.coalesce(F.floor(number(total)), F.lit(0))).join(have, key, "left")
    gaps = joined.withColumn("collected", F.coalesce("collected", F.lit(0))).withColumn(
        "gap", F.col("expected") - F.col("collected")).where(F.col("gap") > 0)
    return gaps.orderBy(F.desc("gap"), key).limit(limit) if limit else gaps


def dist_stats(df: DataFrame, cols: Sequence[str], ddof: int = 0, by: str | Sequence[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation and quartiles, one row per column and group."""
    keys = names(by)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_c")).select(
        *keys, "_c.*")
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    moments = long.groupBy(*keys, "column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), spread("value").alias("std"))
    quarters = quantiles(long, "value", [0.25, 0.5, 0.75], [*keys, "column"]).groupBy(*keys, "column").agg(*[
        F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
        for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    return moments.join(quarters, [*keys, "column"], "left")


def null_profile(df: DataFrame, order: Order = "date", cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: where its first value is, how many values are missing, and how many after the first.

    Positions are compared through the order column, so two aggregates replace a global row number.
    """
    key = names(order)[0]
    cols = list(cols) if cols is not None else [c for c in df.columns if c != key]
    long = df.select(F.col(key), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("missing")) for c in cols])).alias("_c")).select(
        key, "_c.*")
    firsts = long.groupBy("column").agg(
        F.min(F.when(~F.col("missing"), F.col(key))).alias("first_valid"), F.count_if("missing").alias("missing"))
    tail = bounded_join(long.where(F.col("missing")).select(key, "column"), firsts.select("column", "first_valid"),
                        ["column"], "inner")
    after = tail.where(F.col(key) > F.col("first_valid")).groupBy("column").agg(
        F.count(F.lit(1)).alias("_after"))
    return firsts.join(after, "column", "left").select(
        "column", "first_valid", "missing", F.coalesce("_after", F.lit(0)).alias("missing_after_start"),
        (F.coalesce("_after", F.lit(0)) > 0).alias("problem"))


def monthly_mean(df: DataFrame, date: str, column: str | Sequence[str], by: str | Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(*names(by), F.to_date(F.date_trunc("month", F.col(date))).alias("month")).agg(
        *[F.avg(c).alias(c) for c in names(column)])


def row_spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest and largest value of a row and their distance; rows with a missing value are left out."""
    low, high = F.least(*cols), F.greatest(*cols)
    return df.dropna(subset=list(cols)).withColumns({"row_min": low, "row_max": high, "row_gap": high - low})


def topic_mass(df: DataFrame, text: str, weight: str, topics: Mapping[str, str] | None = None,
               default: str = fv.OTHER_TOPIC) -> DataFrame:
    """Weight per topic, each text counting for its first matching topic."""
    return assign_topic(df, text, topics, default).groupBy("topic").agg(F.sum(weight).alias("mass"),
                                                                       F.count(F.lit(1)).alias("n"))


def stratified_sample(df: DataFrame, by: str | Sequence[str], n: int = 40_000, key: str = "comment_id",
                      seed: int = 0, slices: int = 256) -> DataFrame:
    """Up to n rows per group, chosen by a hash of key and seed, so the choice never changes.

    Ranking runs inside slices of the group first; a hot group sends at most n rows per slice on.
    """
    keys = names(by)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    marked = df.withColumn("_draw", draw).withColumn("_slice", F.pmod(F.xxhash64(F.col(key)), F.lit(slices)))
    rank = F.row_number()
    few = marked.withColumn("_r", rank.over(Window.partitionBy(*keys, "_slice").orderBy("_draw", key))).where(
        F.col("_r") <= n)
    few = few.withColumn("_r", rank.over(Window.partitionBy(*keys).orderBy("_draw", key)))
    return few.where(F.col("_r") <= n).drop("_draw", "_slice", "_r")


def with_grid(df: DataFrame, points: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every row once per grid point, with the parameters as columns."""
    return df.withColumn("_g", F.explode(grid(points))).select(*df.columns, "_g.*")


