"""Writing results and appending what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import names


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the store that the path names has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _write(df: DataFrame, path: str, by: Sequence[str], fmt: str, overwrite: bool, options: dict[str, object]) -> None:
    """Write groups as partition folders. With `overwrite` the groups that have new rows are replaced, others stay;
    without it groups that the table already has are left out and the rest is added. Spark writes to a staging folder
    and moves the groups when all tasks are done, so a failed run changes nothing."""
    spark = df.sparkSession
    mode = "overwrite"
    if not overwrite and table_exists(spark, path):
        there = spark.read.format(fmt).schema(df.schema).options(**options).load(path).select(
            *[F.col(k).alias(f"_there_{k}") for k in by]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_there_{k}")) for k in by]
        df, mode = df.join(there, same, "left_anti"), "append"
    df.write.format(fmt).options(**options).option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode(mode).save(path)


def write_split(df: DataFrame, path: str, disposition: Column, by: str | Sequence[str] = "year", fmt: str = "parquet",
                overwrite: bool = True, rows_per_file: int = 5_000_000) -> None:
    """Write kept and dropped rows side by side: one folder per group, `disposition` being a column.

    A rerun replaces a group as a whole, whatever its rows' disposition was before. Rows go out from the tasks
    that hold them, sorted so that a reader of either part skips the blocks of the other.
    """
    keys = names(by)
    rows = df.withColumn("disposition", disposition).sortWithinPartitions(*keys, "disposition")
    options = {"maxRecordsPerFile": rows_per_file} | ({"header": True} if fmt == "csv" else {})
    _write(rows, path, keys, fmt, overwrite, options)


def write_summary(df: DataFrame, path: str, by: str | Sequence[str] = "year", overwrite: bool = True) -> None:
    """Summary rows, nested lists included, as JSON lines, one folder per group; other groups stay as they are."""
    _write(df, path, names(by), "json", overwrite, {"ignoreNullFields": False})


def first_of_each(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """First row of each key in the given order. Keys are ids, so groups are small."""
    pick = F.struct(*[F.col(o) for o in names(order)], *[F.col(c) for c in df.columns if c not in names(order)])
    return df.groupBy(*keys).agg(F.min(pick).alias("_p")).select(*[F.col(f"_p.{c}").alias(c) for c in df.columns])


def incremental_append(df: DataFrame, target: DataFrame | None, keys: str | Sequence[str],
                       order: str | Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks; of each key the first row in the given order, so a rerun picks the same.
    A missing key is a key like others."""
    ids = names(keys)
    single = first_of_each(df, ids, order)
    if target is None:
        return single
    there = target.select(*[F.col(k).alias(f"_there_{k}") for k in ids])
    return single.join(there, [F.col(k).eqNullSafe(F.col(f"_there_{k}")) for k in ids], "left_anti")


def append_news_and_comments(news: DataFrame, comments: DataFrame, target_news: DataFrame, target_comments: DataFrame,
                             order: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """New articles, and the unseen comments of just those articles."""
    fresh = incremental_append(news, target_news, "news_id", [c for c in news.columns if c != "news_id"] or "news_id")
    of_fresh = comments.join(fresh.select("news_id"), "news_id", "left_semi")
    return fresh, incremental_append(of_fresh, target_comments, "comment_id", order)

