"""The append and the daily aggregate as streams, for comments that arrive continuously."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions import fixed_values as fv
from ..functions.columns import clip, names, number
from ..operators.classify import sentiment_norm
from ..session import checkpoint_folder
from ..sources.sinks import first_of_each, incremental_append, table_exists


def unseen_comments(stream: DataFrame, ts: str, key: str, delay: str = "2 days") -> DataFrame:
    """Each comment id once; ids are remembered for the delay, so the state stays bounded."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def append_batch(rows: DataFrame, batch: int, path: str, keys: str | Sequence[str], order: str | Sequence[str]) -> None:
    """Add the rows of one batch whose key no earlier batch has brought, as the folder `batch=<number>` of the table.

    The folder is replaced as a whole and is left out of what counts as known, so a batch that is run again after a
    failure writes the same rows. Of the table only the key columns are read, and only the keys that the batch has go on
    from there: the semi join lets Spark send the smaller batch (or its Bloom filter) to the table and not the table to it.
    """
    spark, ids = rows.sparkSession, names(keys)
    fresh = first_of_each(rows, ids, order).persist()
    try:
        known = None
        if table_exists(spark, path):
            mine = fresh.select(*[F.col(k).alias(f"_mine_{k}") for k in ids])
            table = spark.read.schema(T.StructType([*rows.select(*ids).schema, T.StructField("batch", T.LongType())])).parquet(path)
            known = table.where(F.col("batch") != batch).select(*ids).join(
                mine, [F.col(k).eqNullSafe(F.col(f"_mine_{k}")) for k in ids], "left_semi")
        incremental_append(fresh, known, ids, order).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    finally:
        fresh.unpersist()


def append_stream(stream: DataFrame, path: str, name: str, keys: str | Sequence[str],
                  order: str | Sequence[str]) -> DataStreamWriter:
    """Append each key once, whenever it comes again: the written table is the memory, so no state grows and none expires.

    The keys equal those of `incremental_append` over all rows, however they are cut into batches and across restarts. Of the
    rows of a key the first in the given order counts within a batch, and the earlier batch between batches. One stream
    writes a table at a time; its progress lies in the shared checkpoint folder under `name`.
    """
    folder = f"{checkpoint_folder(stream.sparkSession)}/streams/{name}"
    return stream.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, batch, path, keys, order)).option(
        "checkpointLocation", folder).trigger(availableNow=True)


def daily_sentiment_stream(stream: DataFrame, ts: str, pos: str, neg: str, weight: str | None = None,
                           delay: str = "2 days", tz: str = fv.LOCAL_ZONE) -> DataFrame:
    """Weighted daily sums of a stream in local days; a day is final once the watermark passed it."""
    local = stream.withColumn("_local", F.from_utc_timestamp(ts, tz)).withWatermark("_local", delay)
    w = F.lit(1.0) if weight is None else clip(F.coalesce(number(weight), F.lit(1.0)), 0.0)
    p, n = F.col(pos), F.col(neg)
    total = F.sum(w) + fv.EPS
    daily = local.groupBy(F.window("_local", "1 day").alias("_w")).agg(
        F.count(F.lit(1)).alias("comment_count"), F.sum(w).alias("weight_sum"), F.sum(w * w).alias("weight_sq_sum"),
        (F.sum(sentiment_norm(p, n) * w) / total).alias("sent_norm_w"),
        (F.sum(p * w) / total).alias("pos_mean_w"), (F.sum(n * w) / total).alias("neg_mean_w"))
    return daily.select(F.to_date("_w.start").alias("date"), "comment_count", "weight_sum", "weight_sq_sum",
                        "sent_norm_w", "pos_mean_w", "neg_mean_w")


def append_writer(stream: DataFrame, path: str, name: str, fmt: str = "parquet") -> DataStreamWriter:
    """Append-only sink whose progress is kept in the shared checkpoint folder, so a restart goes on."""
    folder = f"{checkpoint_folder(stream.sparkSession)}/streams/{name}"
    return stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", folder).option(
        "path", path).trigger(availableNow=True)
