"""Trees the queries read, published from the stand-ins once per session and directory.

The ids of the station spine repeat beyond 9,999 suppliers, and its SQL joins the readings of such an id
to each of its descriptions; the trees are published so too.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.functions import time as t
from hourmark.plans.publish import publish
from hourmark.runtime import new_path
from hourmark.sources.readings import month_bounds, timescale_readings
from hourmark.streaming import jobs
from workload.standins import HIST_TODAY, Inputs

EXPORTED_AT = "2002-03-31T00:00:00+00:00"
CORRECTED_MONTHS = [date(1998, m, 1) for m in range(1, 13)]

_made: dict[tuple[str, str, str], str] = {}


def _once(inputs: Inputs, label: str, make: Callable[[str], None]) -> str:
    key = (inputs.spark.sparkContext.applicationId, inputs.sf_dir, label)
    if key not in _made:
        path = new_path(inputs.spark, label)
        make(path)
        _made[key] = path
    return _made[key]


def hist_months(inputs: Inputs) -> DataFrame:
    bounds = month_bounds(inputs.hist_readings(), "time")
    return t.calendar(inputs.spark, HIST_TODAY, bounds=bounds)


def _publish_hist(inputs: Inputs, root: str) -> None:
    hist = inputs.hist_readings()
    publish(
        inputs.spark,
        root,
        lambda months: timescale_readings(hist, months),
        inputs.station_dim(),
        hist_months(inputs),
        EXPORTED_AT,
        each_description=True,
    )


def hist(inputs: Inputs) -> str:
    """All of `raw_hist`, published once."""
    return _once(inputs, "hist", lambda root: _publish_hist(inputs, root))


def corrected(inputs: Inputs) -> str:
    """The same, then one year again from a corrected source, then the dimension tables alone."""

    def make(root: str) -> None:
        _publish_hist(inputs, root)
        source = inputs.corrected()
        publish(
            inputs.spark,
            root,
            lambda months: timescale_readings(source, months),
            inputs.station_dim(),
            t.calendar(inputs.spark, HIST_TODAY, months=CORRECTED_MONTHS),
            EXPORTED_AT,
            each_description=True,
        )
        none = inputs.spark.createDataFrame([], "month date")
        publish(inputs.spark, root, lambda _: source, inputs.renamed_dim(), none, EXPORTED_AT, each_description=True)

    return _once(inputs, "corrected", make)


def streamed(inputs: Inputs) -> str:
    """`raw_hist` published by a stream over the file its readings come from."""

    def make(root: str) -> None:
        spark = inputs.spark
        hist = inputs.hist_readings()
        arriving = _stream(inputs, "lineitem").select(
            (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("time")
        )
        jobs.publish_stream(
            arriving,
            "time",
            root,
            lambda months: timescale_readings(hist, months),
            inputs.station_dim,
            new_path(spark, "stream-state"),
            each_description=True,
        ).awaitTermination()

    return _once(inputs, "streamed", make)


def _stream(inputs: Inputs, table: str) -> DataFrame:
    schema = inputs.table(table).schema
    return inputs.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(inputs.sf_dir)


def _log_stream(inputs: Inputs) -> DataFrame:
    return _stream(inputs, "events").select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key_id"),
        "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
    )


def metered_usage(inputs: Inputs) -> str:
    def make(path: str) -> None:
        jobs.meter_usage(_log_stream(inputs), path, new_path(inputs.spark, "stream-state")).awaitTermination()

    return _once(inputs, "usage", make)


LATE_FILES = 6


def late_usage(inputs: Inputs) -> str:
    """The same totals from a stream of several files, one to a batch, every one with requests of all
    days, so that most come weeks after later ones; added up into a base on the way."""

    def make(path: str) -> None:
        log = inputs.view("api_log").select("key_id", "ts", "bytes")
        landing = new_path(inputs.spark, "late-log")
        log.repartition(LATE_FILES, "bytes").write.parquet(landing)
        arriving = inputs.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        jobs.meter_usage(arriving, path, new_path(inputs.spark, "stream-state"), compact_every=2).awaitTermination()

    return _once(inputs, "late-usage", make)


def metered_minutes(inputs: Inputs) -> str:
    def make(path: str) -> None:
        jobs.meter_minutes(_log_stream(inputs), path, new_path(inputs.spark, "stream-state")).awaitTermination()

    return _once(inputs, "minutes", make)


def registry_files(inputs: Inputs) -> list[str]:
    """The two registry files, each written in listing order."""
    paths = []
    for rank, text in enumerate(inputs.registry_text()):

        def make(path: str, text: DataFrame = text) -> None:
            text.orderBy("k").drop("k").write.csv(path, header=True, escape='"')

        paths.append(_once(inputs, f"registry-{rank}", make))
    return paths


def portal_file(inputs: Inputs) -> str:
    return _once(inputs, "portal", lambda path: inputs.portal().write.csv(path, header=True, escape='"'))
