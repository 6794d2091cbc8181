"""Time the registered queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES (comma separated, optional)
a selection. Each query runs to completion into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moodloom.session import build_session, ship_package  # noqa: E402
from workload import catalog  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for name, run in catalog.QUERIES.items():
        if chosen and name not in chosen:
            continue
        start = time.perf_counter()
        try:
            run(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001
            failed[name] = f"{type(error).__name__}: {str(error)[:300]}"
        print(name, times.get(name, failed.get(name)), file=sys.stderr, flush=True)
    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
              "sf": os.path.basename(os.path.normpath(sf)).removeprefix("sf")}
    if failed:
        result["failed"] = failed
    print(json.dumps(result))


if __name__ == "__main__":
    main()
