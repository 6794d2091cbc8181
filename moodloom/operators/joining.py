"""Joins: chains, lookups, as-of reads and joins against tables of checked size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import lookup, names
from ..session import settle
from .series import running

BROADCAST_BYTES = 16 << 20
MOST_SALTS = 64


def table_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan; for a written table it comes from its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bounded_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
                 max_bytes: int = BROADCAST_BYTES, settled: bool = False) -> DataFrame:
    """Join a large table to one that should be small; missing keys match missing keys.

    The small side is written once and measured. Up to `max_bytes` it is broadcast, so the large
    side is not shuffled. Beyond that each of its rows is copied once per salt and the large side draws
    any salt, so a hot key does not end in one task. Every large row meets exactly one copy, so
    rows are the same either way; inner, left, left_semi and left_anti joins are possible.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no {how} join: rows of the small side may be copied")
    small = small if settled else settle(small)
    keys = names(on)
    size = table_bytes(small)
    renamed = small.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    match = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    extra = [f"_k_{i}" for i in range(len(keys))]
    if size <= max_bytes:
        return big.join(F.broadcast(renamed), match, how).drop(*extra)
    salts = int(min(MOST_SALTS, 2 + size // max(1, max_bytes)))
    salted = big.withColumn("_salt", F.monotonically_increasing_id() % salts)
    copies = renamed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, [*match, F.col("_salt") == F.col("_copy")], how).drop("_salt", "_copy", *extra)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which missing keys match missing keys; the key columns are those of the left side."""
    keys = names(on)
    renamed = right.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    match = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, match, how).drop(*[f"_k_{i}" for i in range(len(keys))])


def outer_chain(dfs: Sequence[DataFrame], on: str | Sequence[str] = "date") -> DataFrame:
    """Full outer join of several tables on shared keys."""
    return reduce(lambda left, right: left.join(right, names(on), "full_outer"), dfs)


def left_merge(base: DataFrame, *dfs: DataFrame, on: str | Sequence[str] = "date") -> DataFrame:
    """Keep every base row and add the columns of the other tables."""
    return reduce(lambda left, right: left.join(right, names(on), "left"), dfs, base)


def join_scores(df: DataFrame, scores: DataFrame, key: str | Sequence[str], order: str | None = None) -> DataFrame:
    """Add scores by key; rows with a missing score are left out and one score per key is used."""
    keys = names(key)
    values = [c for c in scores.columns if c not in keys and c != order]
    complete = scores.dropna(subset=values)
    pick = F.struct(*[F.col(c) for c in ([order] if order else []) + values])
    single = complete.groupBy(*keys).agg(F.min(pick).alias("_pick")).select(*keys, *[f"_pick.{c}" for c in values])
    return df.join(single, keys, "left")


def map_lookup(df: DataFrame, column: str, mapping: Mapping, default=None, name: str | None = None) -> DataFrame:
    """Add the value a small fixed mapping gives for a column."""
    return df.withColumn(name or f"{column}_mapped", lookup(F.col(column), mapping, default))


def asof_compare(df: DataFrame, order: str, value: str | Sequence[str], targets: Mapping[str, str] | None = None,
                 by: str | Sequence[str] | None = None) -> DataFrame:
    """Value at the last row on or before each target date of a series, or at its first row.

    Targets are SQL expressions over `latest`, the last date of the series. The day before the
    latest row is found among earlier rows only. Two aggregates answer every target at once.
    """
    keys, values = names(by), names(value)
    targets = targets if targets is not None else {
        "1 week": "date_sub(latest, 7)", "1 month": "add_months(latest, -1)", "1 year": "add_months(latest, -12)",
    }
    if keys:
        latest = df.groupBy(*keys).agg(F.max(order).alias("latest"))
        rows = bounded_join(df, latest, keys, "inner")
    else:
        rows = df.withColumn("latest", df.agg(F.max(order)).scalar())
    pick = F.struct(F.col(order), *[F.col(v) for v in values])
    at = {"latest": F.col("latest"), **{label: F.expr(text) for label, text in targets.items()}}
    aggregates = [F.min_by(pick, order).alias("_first"), F.max_by(pick, order).alias("_p0"),
                  F.max_by(pick, F.when(F.col(order) < F.col("latest"), F.col(order))).alias("_before")]
    for i, target in enumerate(list(at.values())[1:], start=1):
        aggregates.append(F.max_by(pick, F.when(F.col(order) <= target, F.col(order))).alias(f"_p{i}"))
    summary = rows.groupBy(*keys).agg(*aggregates)
    points = [F.struct(F.lit(label).alias("point"), F.coalesce(F.col(f"_p{i}"), F.col("_first")).alias("row"))
              for i, label in enumerate(at)]
    points.insert(1, F.struct(F.lit("previous").alias("point"), F.coalesce("_before", "_first").alias("row")))
    return (
        summary.select(*keys, F.explode(F.array(*points)).alias("_at"))
        .select(*keys, "_at.point", *[F.col(f"_at.row.{c}") for c in [order, *values]])
    )


def compare_series(a: DataFrame, b: DataFrame, on: str | Sequence[str], value: str = "value",
                   by: str | Sequence[str] | None = None) -> DataFrame:
    """Correlation, mean and largest absolute difference of two series on their shared keys."""
    keys, groups = names(on), names(by)
    joined = a.select(*groups, *keys, F.col(value).alias("_a")).join(
        b.select(*groups, *keys, F.col(value).alias("_b")), [*groups, *keys])
    gap = F.abs(F.col("_a") - F.col("_b"))
    return joined.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).groupBy(*groups).agg(
        F.corr("_a", "_b").alias("corr"), F.avg(gap).alias("mad"), F.max(gap).alias("maxabs"),
        F.count(F.lit(1)).alias("n"))


def swap_columns(df: DataFrame, fresh: DataFrame, cols: Sequence[str], on: str = "date",
                 by: str | Sequence[str] | None = None) -> DataFrame:
    """Replace columns by refreshed ones and carry the last known value forward."""
    keys = names(by)
    merged = df.drop(*cols).join(fresh.select(*keys, on, *cols), [*keys, on], "left")
    filled = running(merged, {f"_{c}": ("last", F.col(c)) for c in cols}, on, keys)
    return filled.drop(*cols).withColumnsRenamed({f"_{c}": c for c in cols})


def expanding_blocks(df: DataFrame, order: str, min_obs: int = 60, block: int = 256,
                     by: str | Sequence[str] | None = None) -> DataFrame:
    """Training rows of an expanding fit, without pairing every row with every later one.

    Rows are numbered per series and cut into blocks of positions. Each row is copied once per
    later block, so block b holds the rows a fit inside b may read; `_pos` tells which of them
    precede a given row. A series holds one row per date, which bounds its length.
    """
    keys = names(by)
    rows = Window.partitionBy(*keys).orderBy(order)
    last = Window.partitionBy(*keys)
    numbered = df.withColumn("_pos", F.row_number().over(rows) - 1).withColumn("_n", F.count(F.lit(1)).over(last))
    start = F.greatest((F.col("_pos") / block).cast("int"), F.lit(min_obs // block))
    end = ((F.col("_n") - 1) / block).cast("int")
    return (
        numbered.where(end >= start).withColumn("_block", F.explode(F.sequence(start, end)))
        .drop("_n")
    )


def by_block(blocks: DataFrame, by: str | Sequence[str] | None = None):
    """Blocks of `expanding_blocks` as groups for a fit. The work of a block is far larger than its bytes, so the
    number of partitions follows the cores and is not joined up again by size."""
    spark = blocks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    keys = [*names(by), "_block"]
    return blocks.repartition(parts, *keys).groupBy(*keys)
