"""Windows over ordered series, and the same windows over series too long for one task.

A daily series holds at most one row per date, so a plain window per series is bounded by the
calendar. For finer data pass `spans`: rows get a distributed position number, the series is cut
into spans of positions, and

* bounded frames run per span on the span's rows plus the few neighbours the frame reaches;
* running values (sum, max, last) run per span and add the carry of the earlier spans.

Both give the result of the plain window; no task ever holds more than a span and its margin.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.columns import ColumnLike, col, names

Order = str | Sequence[str]


@dataclass(frozen=True)
class Spans:
    """How to cut a long series: `block` is an expression that never falls along the order
    (a date, an hour), `rows` the length of a span, `position` a column that already numbers the rows."""

    block: str
    rows: int = 4096
    position: str | None = None


def ordered(order: Order, by: Order | None = None) -> WindowSpec:
    return Window.partitionBy(*names(by)).orderBy(*names(order))


def with_position(df: DataFrame, order: Order, by: Order | None, block: str, name: str = "_pos") -> DataFrame:
    """Number the rows of each series from 0 without sorting a series in one task.

    Rows are counted per (series, block), the counts are summed up over earlier blocks, and the
    number inside the block is added.
    """
    keys = names(by)
    marked = df.withColumn("_block", F.expr(block))
    counts = marked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    match = F.col("_block").eqNullSafe(F.col("_k_block"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*names(order))
    return (
        marked.join(starts, match)
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_block", "_start", "_k_block", *[f"_k_{k}" for k in keys])
    )


def _positions(df: DataFrame, order: Order, keys: Sequence[str], spans: Spans) -> DataFrame:
    if spans.position:
        return df.withColumn("_pos", F.col(spans.position))
    return with_position(df, order, keys, spans.block)


def over_frames(df: DataFrame, columns: Callable[[WindowSpec], Mapping[str, Column]], order: Order,
                by: Order | None = None, before: int = 0, after: int = 0, spans: Spans | None = None) -> DataFrame:
    """Add window columns whose frames reach at most `before` rows back and `after` rows ahead."""
    keys = names(by)
    if spans is None:
        return df.withColumns(dict(columns(ordered(order, keys))))
    size = max(spans.rows, before + after + 1)
    pos = _positions(df, order, keys, spans)
    own = F.floor(F.col("_pos") / size)
    first = F.floor(F.greatest(F.col("_pos") - after, F.lit(0)) / size)
    last = F.floor((F.col("_pos") + before) / size)
    copies = pos.withColumn("_own", own).withColumn("_span", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*keys, "_span").orderBy("_pos")
    return (
        copies.withColumns(dict(columns(window)))
        .where(F.col("_span") == F.col("_own")).drop("_span", "_own", "_pos")
    )


def running(df: DataFrame, items: Mapping[str, tuple], order: Order, by: Order | None = None,
            spans: Spans | None = None) -> DataFrame:
    """Add running values from the start of each series.

    An item is (kind, column) or (kind, column, upto): kind is sum, max, min, count or last (last
    non-null), upto is 0 to include the current row and -1 to stop before it.
    """
    keys = names(by)
    calls = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count,
             "last": lambda c: F.last(c, ignorenulls=True)}
    merges = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum,
              "last": lambda c: F.last(c, ignorenulls=True)}
    parts = {name: (item[0], col(item[1]), item[2] if len(item) > 2 else 0) for name, item in items.items()}
    if spans is None:
        window = ordered(order, keys)
        return df.withColumns({
            name: calls[kind](value).over(window.rowsBetween(Window.unboundedPreceding, upto))
            for name, (kind, value, upto) in parts.items()})

    pos = _positions(df, order, keys, spans).withColumn("_span", F.floor(F.col("_pos") / spans.rows))
    window = Window.partitionBy(*keys, "_span").orderBy("_pos")
    local = pos.withColumns({
        f"_l_{name}": calls[kind](value).over(window.rowsBetween(Window.unboundedPreceding, upto))
        for name, (kind, value, upto) in parts.items()})
    totals = pos.groupBy(*keys, "_span").agg(*[
        (F.max_by(value, F.when(value.isNotNull(), F.col("_pos"))) if kind == "last" else calls[kind](value))
        .alias(f"_t_{name}") for name, (kind, value, _) in parts.items()])
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_span").alias("_k_span"),
        *[merges[kind](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _, _) in parts.items()])
    match = F.col("_span") == F.col("_k_span")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))

    def combine(name: str, kind: str) -> Column:
        here, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "last":
            return F.coalesce(here, carry)
        if kind == "max":
            return F.greatest(here, carry)
        if kind == "min":
            return F.least(here, carry)
        return F.coalesce(here + carry, here, carry)

    joined = local.join(carries, match, "left")
    return joined.withColumns({name: combine(name, kind) for name, (kind, _, _) in parts.items()}).drop(
        "_pos", "_span", "_k_span", *[f"_k_{k}" for k in keys],
        *[f"_l_{n}" for n in parts], *[f"_c_{n}" for n in parts])


def column_name(value: ColumnLike, suffix: str) -> str:
    return f"{value}_{suffix}" if isinstance(value, str) else suffix
