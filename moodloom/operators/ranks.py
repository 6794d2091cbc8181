"""Exact quantiles and ranks of large groups, without ordering a group in one task.

Rows collapse to value counts. A mergeable sketch gives block bounds per group, more of them the more
values the group has; values are placed between the bounds and ordered inside their block only. A
block's offset is the number of rows in the blocks before it. The sketch balances the work; it never
changes a result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import names
from ..session import settle
from .joining import bounded_join, null_safe_join

MOST_BLOCKS = 1024
VALUES_PER_BLOCK = 50_000
STRIDE = 32


def _block_of(value: Column, bounds: Column, coarse: Column) -> Column:
    """Number of bounds below the value: a look at every 32nd bound, then at 32 of them."""
    group = F.size(F.filter(coarse, lambda b: b < value))
    fine = F.slice(bounds, group * STRIDE + 1, F.lit(STRIDE))
    return group * STRIDE + F.size(F.filter(fine, lambda b: b < value))


def value_blocks(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Value counts `_n` of each group with the block `_block` they fall into."""
    # Written once: the sketch, the block sizes and the ranks all read the counts, never the rows again.
    cells = settle(df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n")))
    at = [(i + 1) / MOST_BLOCKS for i in range(MOST_BLOCKS - 1)]
    sketch = cells.groupBy(*by).agg(
        F.percentile_approx(column, at, 2 * MOST_BLOCKS).alias("_all"), F.count(F.lit(1)).alias("_values"))
    wanted = F.least(F.ceil(F.col("_values") / VALUES_PER_BLOCK), F.lit(MOST_BLOCKS))
    step = F.ceil(F.lit(MOST_BLOCKS) / wanted)
    kept = F.filter("_all", lambda _, i: (i + 1) % step == 0)
    bounds = sketch.withColumn("_bounds", F.array_distinct(kept)).select(
        *by, "_bounds", F.filter("_bounds", lambda _, i: i % STRIDE == STRIDE - 1).alias("_coarse"))
    placed = bounded_join(cells, bounds, by, "inner")
    return placed.withColumn("_block", _block_of(F.col(column), F.col("_bounds"), F.col("_coarse"))).drop(
        "_bounds", "_coarse")


def _block_starts(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    counted = placed.groupBy(*by, "_block").agg(F.sum("_n").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumns({
        "_start": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        "_total": F.sum("_rows").over(Window.partitionBy(*by))})


def _grouped(df: DataFrame, by: str | Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    keys = names(by)
    return (df, keys) if keys else (df.withColumn("_one", F.lit(0)), ["_one"])


def quantiles(df: DataFrame, column: str, qs: Sequence[float], by: str | Sequence[str] | None = None) -> DataFrame:
    """Quantiles with linear interpolation, one row per group and q."""
    base, anchor = _grouped(df.select(*names(by), F.col(column).cast("double").alias("_v")), by)
    placed = value_blocks(base, "_v", anchor)
    starts = _block_starts(placed, anchor)
    ranks = F.array(*[F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("rank"))
                      for q in qs])
    needed = starts.withColumn("_w", F.explode(ranks)).where(
        (F.floor("_w.rank") < F.col("_start") + F.col("_rows")) & (F.ceil("_w.rank") >= F.col("_start"))).select(
        *anchor, "_block", "_start", "_w.q", "_w.rank")
    within = Window.partitionBy(*anchor, "q", "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = null_safe_join(placed, needed, [*anchor, "_block"]).withColumn("_end", F.col("_start") + F.sum("_n").over(within))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_n") <= rank) & (rank < F.col("_end")), F.col("_v")))

    found = ordered.groupBy(*anchor, "q", "rank").agg(
        value_at(F.floor("rank")).alias("_lo"), value_at(F.ceil("rank")).alias("_hi"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("rank") - F.floor("rank"))
    return found.select(*names(by), "q", value.alias("value"))


def with_quantiles(df: DataFrame, column: str, columns: Mapping[str, float], by: str | Sequence[str] | None = None) -> DataFrame:
    """Add quantiles of each group as columns of the given names."""
    keys = names(by)
    found = quantiles(df, column, list(columns.values()), keys)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for n, q in columns.items()])
    if keys:
        return bounded_join(df, wide, keys, "left")
    return df.withColumn("_wide", wide.select(F.struct("*").alias("_w")).scalar()).select("*", "_wide.*").drop("_wide")


def average_rank(df: DataFrame, column: str, by: str | Sequence[str] | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1; equal values share their mean rank."""
    base, anchor = _grouped(df, by)
    placed = value_blocks(base, column, anchor)
    starts = _block_starts(placed, anchor).select(*anchor, "_block", "_start")
    inside = Window.partitionBy(*anchor, "_block").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe_join(placed, starts, [*anchor, "_block"]).withColumn(
        name, F.col("_start") + F.sum("_n").over(inside) - (F.col("_n") - 1) / 2.0)
    # Few values are broadcast; many are copied over salts, so that a frequent value is spread.
    return bounded_join(base, ranked.select(*anchor, column, name), [*anchor, column], "left").drop("_one")


def spearman(df: DataFrame, a: str, b: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Rank correlation, its two-sided p-value (Student's t; null below three pairs) and the direction its sign suggests."""
    from .inference import two_sided_p

    keys = names(by)
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = average_rank(average_rank(pairs, "_a", keys, "_ra"), "_b", keys, "_rb")
    out = ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))
    rest = F.greatest(F.lit(0.0), 1.0 - F.col("rho") * F.col("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.when(rest > 0, rest))
    # Ranks that agree entirely have no spread left.
    p = F.when((rest <= 0) & (F.col("n") > 2), 0.0).otherwise(two_sided_p(t, (F.col("n") - 2).cast("double")))
    return out.withColumns({"p_value": p, "momentum": F.col("rho") > 0})
