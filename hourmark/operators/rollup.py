"""Hourly, daily and monthly roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.functions import time as t

RAW_COLUMNS = ["station_id", "parameter_name", "unit", "collected_at", "value"]


def period_rollup(fact: DataFrame, grain: str) -> DataFrame:
    """Mean, least, greatest and number of readings per station, parameter, unit and period.

    The aggregates are fixed-width, so both sides of the shuffle are hash aggregates and a hot
    station shrinks to one row per period and task before it moves.
    """
    return fact.groupBy(
        "station_id",
        "parameter_name",
        "unit",
        t.period_start(F.col("collected_at"), grain).alias("period_start"),
    ).agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n"),
    )


def mean_of_means(rollup: DataFrame) -> DataFrame:
    """Unweighted mean over series of each period's mean."""
    return rollup.groupBy("period_start").agg(F.avg("mean").alias("mean"))
