"""Ranks and quantiles of long sliding frames.

A series is cut into spans of positions, each with the rows its frames reach back to. Inside a span the known values of
the frame stay in one sorted list: a row adds its value, drops the one that leaves and looks the answer up by bisection.
The cost of a row hardly depends on the frame, and a task holds a span and its margin only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import names
from .series import Order, Spans, ordered, with_position

SPAN_ROWS = 4096
MARGINS = 4


def _share(held: list[int], levels: np.ndarray, last: int, q: float) -> float:
    return 100.0 * bisect_right(held, last) / len(held)


def _quantile(held: list[int], levels: np.ndarray, last: int, q: float) -> float:
    place = (len(held) - 1) * q
    low, high = floor(place), ceil(place)
    below, above = float(levels[held[low]]), float(levels[held[high]])
    return below if held[low] == held[high] else (high - place) * below + (place - low) * above


def slide(values: np.ndarray, known: np.ndarray, n: int, needed: int, q: float | None = None) -> list[float | None]:
    """Per row: the percent rank of the last known value, or quantile `q`, of the known values of the last n rows.

    None while fewer than `needed` values (one at least) are known. Values are replaced by their place among the
    distinct ones, so that ties are exact and NaN, as in Spark, is above all numbers and equal to itself.
    """
    levels, places = np.unique(values[known], return_inverse=True)
    codes = np.full(len(values), -1, dtype=np.int64)
    codes[known] = places.reshape(-1)
    codes = codes.tolist()
    answer = _share if q is None else _quantile
    held: list[int] = []
    found: list[float | None] = []
    last = -1
    for i, code in enumerate(codes):
        if i >= n and codes[i - n] >= 0:
            del held[bisect_left(held, codes[i - n])]
        if code >= 0:
            insort(held, code)
            last = code
        found.append(answer(held, levels, last, q) if len(held) >= max(needed, 1) else None)
    return found


def over_sorted_frames(df: DataFrame, column: str, n: int, needed: int, name: str, q: float | None = None,
                       order: Order = "date", by: Order | None = None, spans: Spans | None = None) -> DataFrame:
    """Add the percent rank of the last known value (or quantile q) of the last n rows of each series.

    Rows, other columns and their types stay as they are; an existing column `name` is replaced. An empty table stays
    empty.
    """
    keys, columns = names(by), df.columns
    kept = [c for c in columns if c != name]
    valued = df.withColumn("_v", F.col(column).cast("double"))
    if spans is None:
        placed = valued.withColumn("_pos", F.row_number().over(ordered(order, keys)).cast("bigint") - 1)
    elif spans.position:
        placed = valued.withColumn("_pos", F.col(spans.position).cast("bigint"))
    else:
        placed = with_position(valued, order, keys, spans.block)
    size = max(SPAN_ROWS if spans is None else spans.rows, MARGINS * n)
    own = F.floor(F.col("_pos") / size)
    reached = F.floor((F.col("_pos") + n - 1) / size)
    groups = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    # A copy in a later span only lends its value; a row's other columns travel once, in its own span.
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_none"))
    copies = placed.select(*groups, "_pos", "_v", row.alias("_row"), own.alias("_own"),
                           F.explode(F.sequence(own, reached)).alias("_span"))
    copies = copies.withColumn("_row", F.when(F.col("_span") == F.col("_own"), F.col("_row")))
    shape = copies.select("_row").withColumn("_out", F.lit(None).cast("double")).schema

    def compute(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        raw = table["_v"].combine_chunks()
        known = np.asarray(raw.is_valid())
        values = np.asarray(raw.fill_null(0.0), dtype=np.float64)
        found = pa.array(slide(values, known, n, needed, q), pa.float64(), from_pandas=False)
        mine = pc.equal(table["_own"], table["_span"])
        return pa.table({"_row": table["_row"], "_out": found}).filter(mine)

    done = copies.groupBy(*[f"_k{i}" for i in range(len(keys))], "_span").applyInArrow(compute, shape)
    out = [F.col("_out").alias(name) if c == name else F.col(f"_row.`{c}`").alias(c) for c in columns]
    return done.select(*out, *([] if name in columns else [F.col("_out").alias(name)]))
