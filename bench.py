"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the test directory, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from hourmark import session
from hourmark.plans.publish import publish
from hourmark.runtime import new_path
from hourmark.sources.readings import timescale_readings
from workload import trees
from workload.queries import QUERIES
from workload.standins import Inputs

HEADLINE = [
    "rollup_hourly",
    "rollup_daily",
    "rollup_monthly",
    "measurements_tree",
    "raw_slice",
    "capped_slice",
    "capped_slice_flag",
    "capped_slice_counted",
    "scan_pruned",
    "canonical_fact",
    "station_resolve",
    "stations_table",
    "parameters_table",
    "manifest_months",
    "coverage_by_source",
    "city_daily_mean",
    "city_rolling7",
    "diurnal_cycle",
    "pivot_hour_city",
    "station_means",
    "rank_extremes",
    "city_month_mean",
    "network_mean_by_time",
    "mean_of_means",
    "usage_daily",
    "usage_report",
    "limit_breaches",
    "users_latest_key",
    "profile_merge",
]
RUNS = 2
# Built once per session, so timed once, from nothing.
ONCE = ["incremental_republish", "stream_publish", "stream_usage", "stream_usage_late", "stream_breaches", "sink_formats"]
# The large publish holds every reading this many times, at times of its own.
LARGE = 10


def seconds(work) -> float:
    started = time.perf_counter()
    work()
    return time.perf_counter() - started


def publish_large(inputs: Inputs) -> int:
    """Publish the history LARGE times as dense; returns the rows published."""
    hist = inputs.hist_readings()
    minutes = F.explode(F.sequence(F.lit(0), F.lit(LARGE - 1))).alias("minute")
    dense = hist.select("*", minutes).withColumn("time", F.timestamp_add("MINUTE", F.col("minute"), F.col("time"))).drop("minute")
    made = publish(
        inputs.spark, new_path(inputs.spark, "bench-large"), lambda months: timescale_readings(dense, months), inputs.station_dim(), trees.hist_months(inputs)
    )
    return made.manifest.select("measurements.rows").first()[0]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = session("bench", f"local[{cpus}]", **{"spark.driver.memory": "8g", **settings})
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Inputs.of(spark, sf_dir)
    times: dict[str, float] = {}

    trees.hist(inputs)  # warms up, and is what the tree queries read
    times["publish_full"] = seconds(lambda: trees._publish_hist(inputs, new_path(spark, "bench")))
    started = time.perf_counter()
    large_rows = publish_large(inputs)
    times["publish_large"] = time.perf_counter() - started
    for name in ONCE:
        times[name] = seconds(lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    for name in HEADLINE:
        def run(name: str = name) -> None:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

        times[name] = min(seconds(run) for _ in range(RUNS))
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                "runs": RUNS,
                "publish_rows_per_sec": round(large_rows / times["publish_large"]),
            }
        )
    )
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
