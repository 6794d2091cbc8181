"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Edges that one task may join: some hundred bytes each.
FEW = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of every partition replaced by those from each of its nodes to the smallest one it is connected with
    there: at most one per node. A task holds the edges of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while up.get(top, top) != top:
                top = up[top]
            while up.get(x, x) != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                up[max(a, b)] = min(a, b)
        nodes = [x for x in up if root(x) != x]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _mark(edges: DataFrame) -> tuple:
    """A number of edges and a sum over them that change if the edges do."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Partitions contract their own edges first. If few are left, counted, one task joins them. Otherwise large and small
    stars alternate: aggregates and joins over edges, minima being combined before the shuffle and nodes with
    many edges split by the skewed join. Only counts and sums reach the driver.
    """
    few = FEW if few is None else few
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    now = c.settle(contracted(now), "edges")
    last = _mark(now)
    if last[0] <= few:
        now = c.settle(contracted(now.coalesce(1)), "edges")
    else:
        while True:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            small = large.groupBy("u").agg(F.min("v").alias("m"))
            rest = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = c.settle(small.select("u", F.col("m").alias("v")).unionByName(rest).distinct(), "edges")
            mark = _mark(now)
            if mark == last:
                break
            last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
