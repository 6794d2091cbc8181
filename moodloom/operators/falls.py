"""Deepest fall from a peak as a mergeable summary.

A record of neighbouring rows keeps the sum of their log returns, the highest and lowest level reached inside and the
deepest fall from a level to a later one, all measured from the level before the first row. Records of neighbouring
blocks combine into one of both, so a series is summed up block by block, then over blocks of blocks; no task holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import names
from .series import Order


def fall_records(df: DataFrame, ret: str, order: Order = "date", by: Order | None = None,
                 block: str = "date_trunc('month', date)") -> DataFrame:
    """One record per series and block: `rows`, `total`, `highest`, `lowest` and `deepest` of its known log returns.

    `block` is an expression that never falls along the order. Missing returns are left out; a block without any has no
    record.
    """
    keys = names(by)
    known = df.where(F.col(ret).isNotNull()).select(
        *keys, F.expr(block).alias("block"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(names(order))],
        F.col(ret).cast("double").alias("_ret"))
    inside = Window.partitionBy(*keys, "block").orderBy(*[f"_o{i}" for i in range(len(names(order)))]).rowsBetween(
        Window.unboundedPreceding, 0)
    levels = known.withColumn("_level", F.sum("_ret").over(inside))
    fallen = levels.withColumn("_fall", F.col("_level") - F.max("_level").over(inside))
    return fallen.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_ret").alias("total"), F.max("_level").alias("highest"),
        F.min("_level").alias("lowest"), F.min("_fall").alias("deepest"))


def merged_falls(records: DataFrame, by: Order | None = None, into: str | None = None) -> DataFrame:
    """Records of neighbouring blocks combined, per series or per coarser block `into` (an expression over `block`)."""
    keys = names(by)
    if into is not None:
        records, keys = records.withColumn("_into", F.expr(into)), [*keys, "_into"]
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("total").over(earlier), F.lit(0.0))
    placed = records.withColumn("_start", start).withColumns({
        "highest": F.col("_start") + F.col("highest"), "lowest": F.col("_start") + F.col("lowest")})
    # The lowest level of a block falls from the highest of the blocks before it, or the deepest fall lies inside.
    fallen = placed.withColumn("deepest", F.least("deepest", F.col("lowest") - F.max("highest").over(earlier)))
    merged = fallen.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.max("highest").alias("highest"),
        F.min("lowest").alias("lowest"), F.min("deepest").alias("deepest"))
    return merged if into is None else merged.withColumnRenamed("_into", "block")


def max_drawdown(df: DataFrame, ret: str, order: Order = "date", by: Order | None = None,
                 blocks: str | Sequence[str] = "date_trunc('month', date)") -> DataFrame:
    """Deepest fall of each series' growth from its running peak, `mdd` (0 or below), and its known `rows`.

    The first block is an expression over the rows; each further one is coarser, an expression over `block`. The peak
    starts at the first known value. A series without any known return has no row.
    """
    first, *coarser = names(blocks)
    records = fall_records(df, ret, order, by, first)
    for into in coarser:
        records = merged_falls(records, by, into)
    return merged_falls(records, by).select(*names(by), "rows", (F.exp("deepest") - 1).alias("mdd"))
