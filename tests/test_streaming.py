"""A stream over several batches ends where the batch job does."""

import os
from datetime import date, datetime, timedelta

from hourmark.operators import usage
from hourmark.sources import readings, tree
from hourmark.streaming import jobs
from tests.test_publish import dimension, rows_of, run, source

ONE_FILE = {"availableNow": True}


def log_rows(spark, hours):
    start = datetime(2024, 1, 1)
    rows = [(f"k{n % 5}", start + timedelta(hours=h, seconds=n), n) for h in hours for n in range(40)]
    return spark.createDataFrame(rows, "key_id string, ts timestamp_ntz, bytes bigint")


def arriving(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_metering(spark, tmp_path):
    landing = str(tmp_path / "log")
    first = log_rows(spark, [0, 5])
    first.coalesce(1).write.parquet(landing)
    totals, counts = str(tmp_path / "totals"), str(tmp_path / "counts")
    for step in range(3):
        jobs.meter_usage(arriving(spark, landing, first.schema), totals, str(tmp_path / "c1")).awaitTermination()
        jobs.meter_minutes(arriving(spark, landing, first.schema), counts, str(tmp_path / "c2")).awaitTermination()
        if step < 2:  # more of the same day arrives after a restart, then another day
            log_rows(spark, [5, 6] if step == 0 else [30]).coalesce(1).write.mode("append").parquet(landing)
    log = spark.read.parquet(landing)
    columns = ["key_id", "day", "requests", "bytes", "last_used"]
    assert rows_of(jobs.metered_usage(spark, totals).select(columns)) == rows_of(usage.usage_daily(log).select(columns))
    keys = spark.createDataFrame([("k1", "free")], "id string, tier string")
    limits = {"free": 3, "demo": 7}
    streamed = rows_of(jobs.metered_breaches(spark, counts, keys, limits))
    assert streamed == rows_of(usage.over_limit(usage.requests_per_minute(log), keys, limits)) != []


def test_requests_that_come_days_late_count(spark, tmp_path):
    """One file per batch: days 20, 10, 21, 10, in a base and after it, and a batch that runs again."""
    landing, totals, counts = (str(tmp_path / n) for n in ("log", "totals", "counts"))
    for day in (20, 10, 21, 10):
        rows = [("k1", datetime(2024, 1, day, 3, 0, n % 60), n) for n in range(70)]
        spark.createDataFrame(rows, "key_id string, ts timestamp_ntz, bytes bigint").coalesce(1).write.mode("append").parquet(landing)
        for every in (2,):
            jobs.meter_usage(arriving(spark, landing, "key_id string, ts timestamp_ntz, bytes bigint"), totals, str(tmp_path / "c1"), compact_every=every).awaitTermination()
            jobs.meter_minutes(arriving(spark, landing, "key_id string, ts timestamp_ntz, bytes bigint"), counts, str(tmp_path / "c2"), compact_every=every).awaitTermination()
    log = spark.read.parquet(landing)
    columns = ["key_id", "day", "requests", "bytes", "last_used"]
    assert rows_of(jobs.metered_usage(spark, totals).select(columns)) == rows_of(usage.usage_daily(log).select(columns))
    keys = spark.createDataFrame([("k1", "trial")], "id string, tier string")
    found = jobs.metered_breaches(spark, counts, keys).collect()
    assert sorted((r.window_start.day, r.n, r.max_requests) for r in found) == [(10, 140, 60), (20, 70, 60), (21, 70, 60)]
    assert jobs._numbered(spark, totals, "base") and len(jobs._numbered(spark, totals, "batch")) < 4


def test_publishing(spark, tmp_path):
    raw, root, whole = (str(tmp_path / n) for n in ("raw", "tree", "whole"))
    months = [date(2024, 1, 1), date(2024, 2, 1)]
    source(spark, months[:1]).coalesce(1).write.parquet(raw)

    asked = []

    def published():
        table = spark.read.parquet(raw)
        return jobs.publish_stream(
            arriving(spark, raw, table.schema), "time", root,
            lambda months: asked.append(months) or readings.timescale_readings(spark.read.parquet(raw), months),
            lambda: dimension(spark), str(tmp_path / "state"),
        )

    published().awaitTermination()
    # a late file touches the first month again and opens the second
    source(spark, months, bump=0.25).coalesce(1).write.mode("append").parquet(raw)
    published().awaitTermination()
    run(spark, whole, spark.read.parquet(raw), months)
    assert rows_of(tree.scan_tree(spark, root)) == rows_of(tree.scan_tree(spark, whole))
    assert rows_of(tree.read_stations(spark, root)) == rows_of(tree.read_stations(spark, whole))

    # a batch that was published, but not noted as done by the stream, is not published again
    before, count = tree.load_manifest(spark, root), len(asked)
    for name in (f"{tmp_path}/state/commits/1", f"{tmp_path}/state/commits/.1.crc"):
        if os.path.exists(name):
            os.remove(name)
    published().awaitTermination()
    assert len(asked) == count and tree.load_manifest(spark, root) == before
    assert before["batches"] == {jobs.stream_id(spark, str(tmp_path / "state")): 1}
