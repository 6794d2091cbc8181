"""Appending as a stream equals the batch append, in any batching, when batches run again and across restarts."""

from __future__ import annotations

import datetime as dt

from moodloom.sources import sinks
from moodloom.streaming import appends

SCHEMA = "id string, ts timestamp, body string"


def rows(spark, spec):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + dt.timedelta(days=d), f"{i}@{d}") for i, d in spec], SCHEMA)


# "a" and the missing id come back after far more than any watermark.
ARRIVALS = [[("a", 0), ("b", 0), ("a", 1), (None, 1)], [("c", 3), ("b", 3)], [("a", 400), (None, 400), ("d", 400)], []]


def table(spark, path):
    return sorted((r["id"] or "", r["body"]) for r in spark.read.parquet(path).collect())


def run(spark, tmp_path, batches, restarts):
    """Feed each batch as a file; the stream is stopped and started again after every file or only once."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, spec in enumerate(batches):
        rows(spark, spec).coalesce(1).write.mode("append").parquet(source)
        if restarts or n == len(batches) - 1:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            appends.append_stream(stream, out, f"t-{tmp_path.name}", "id", "ts").start().awaitTermination()
    return table(spark, out)


def test_equals_batch_append_in_any_batching(spark, tmp_path):
    whole = [x for part in ARRIVALS for x in part]
    expected = sorted((r["id"] or "", r["body"]) for r in
                      sinks.incremental_append(rows(spark, whole), None, "id", "ts").collect())
    for name, batches, restarts in (("one", [whole], False), ("restarted", ARRIVALS, True)):
        folder = tmp_path / name
        folder.mkdir()
        assert run(spark, folder, batches, restarts) == expected
    assert len(expected) == 5


def test_batch_run_again_writes_the_same(spark, tmp_path):
    path = str(tmp_path / "out")
    for batch, spec in enumerate(ARRIVALS):
        appends.append_batch(rows(spark, spec), batch, path, "id", "ts")
    before = table(spark, path)
    for batch in (2, 1, 0):
        appends.append_batch(rows(spark, ARRIVALS[batch]), batch, path, "id", "ts")
        assert table(spark, path) == before
    # A batch that died halfway left part of its rows: run again, it is complete.
    rows(spark, ARRIVALS[1][:1]).write.mode("overwrite").parquet(f"{path}/batch=1")
    appends.append_batch(rows(spark, ARRIVALS[1]), 1, path, "id", "ts")
    assert table(spark, path) == before
