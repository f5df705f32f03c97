"""Continuous publishing, usage metering and limit reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hourmark.functions import time as t
from hourmark.operators import usage
from hourmark.plans.publish import delete, exists, publish
from hourmark.sources import tree


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream with this checkpoint; a new checkpoint counts its batches anew."""
    return json.loads(tree.read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def publish_stream(
    stream: DataFrame,
    at: str,
    root: str,
    readings: Callable[[list[date]], DataFrame],
    station_dim: Callable[[], DataFrame],
    checkpoint: str,
    trigger: dict | None = None,
    each_description: bool = False,
) -> StreamingQuery:
    """Re-publish the months that new raw readings fall in.

    A micro-batch only says which months have changed. Those are read again in full from the raw
    table, because overwriting a month with the batch alone would lose the rest of it. The manifest
    keeps the number of the last batch, so one that runs again after a stop ends at once.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        touched = batch.where(F.col(at).isNotNull()).select(t.month_of(F.col(at)).alias("month")).distinct()
        batch_id = (stream_id(spark, checkpoint), number)
        publish(spark, root, readings, station_dim(), touched, batch=batch_id, each_description=each_description)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# -- totals ---------------------------------------------------------------------
#
# A micro-batch is summed and written under its number; a total is the sum over all batches. Nothing
# has to arrive in time, so nothing is ever dropped, and no state is kept. A batch that runs again
# replaces its own rows. Every so many batches those before are added up into a base.

COMPACT_EVERY = 100


def _numbered(spark: SparkSession, path: str, label: str) -> list[int]:
    """Numbers of the complete `label=N` folders under a path, in order."""
    folder, files = tree.file_system(spark, path)
    if not files.exists(folder):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in files.listStatus(folder)]
    done = [int(n.split("=")[1]) for n, full in names if n.startswith(f"{label}=") and exists(spark, f"{full}/_SUCCESS")]
    return sorted(done)


def batch_sums(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The sums of all batches, those before the newest base as one."""
    bases = _numbered(spark, path, "base")
    newest = bases[-1] if bases else -1
    folders = [f"{path}/batch={n}" for n in _numbered(spark, path, "batch") if n > newest]
    folders += [f"{path}/base={newest}"] if bases else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: str, add: Callable[[DataFrame], DataFrame]) -> None:
    """Add up what there is into a new base. What the base before it held is deleted only now, so that
    a reader that began with that base can finish."""
    bases, batches = _numbered(spark, path, "base"), _numbered(spark, path, "batch")
    if not batches or (bases and batches[-1] <= bases[-1]):
        return
    add(batch_sums(spark, path, schema)).write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")
    before = bases[-1] if bases else -1
    for n in batches:
        if n <= before:
            delete(spark, f"{path}/batch={n}")
    for n in bases[:-1]:
        delete(spark, f"{path}/base={n}")


def _add_up(
    stream: DataFrame,
    summed: Callable[[DataFrame], DataFrame],
    add: Callable[[DataFrame], DataFrame],
    schema: str,
    path: str,
    checkpoint: str,
    trigger: dict | None,
    every: int,
) -> StreamingQuery:
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        bases = _numbered(spark, path, "base")
        if bases and number <= bases[-1]:
            return  # counted in the base already
        summed(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % every == every - 1:
            compact(spark, path, schema, add)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


USAGE = "key_id string, day date, requests bigint, bytes bigint, last_used timestamp_ntz"
MINUTES = "key_id string, window_start timestamp_ntz, n bigint"


def _add_usage(sums: DataFrame) -> DataFrame:
    return sums.groupBy("key_id", "day").agg(
        F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"), F.max("last_used").alias("last_used")
    )


def _add_minutes(sums: DataFrame) -> DataFrame:
    return sums.groupBy("key_id", "window_start").agg(F.sum("n").alias("n"))


def meter_usage(
    log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Requests and bytes per key and UTC day of a request stream, read with `metered_usage`."""
    return _add_up(log, usage.usage_daily, _add_usage, USAGE, path, checkpoint, trigger, compact_every)


def metered_usage(spark: SparkSession, path: str) -> DataFrame:
    return _add_usage(batch_sums(spark, path, USAGE))


def meter_minutes(
    log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Requests per key and minute of a request stream, read with `metered_breaches`."""
    return _add_up(log, usage.requests_per_minute, _add_minutes, MINUTES, path, checkpoint, trigger, compact_every)


def metered_breaches(
    spark: SparkSession, path: str, keys: DataFrame, limits: dict[str, int] | None = None
) -> DataFrame:
    return usage.over_limit(_add_minutes(batch_sums(spark, path, MINUTES)), keys, limits)
