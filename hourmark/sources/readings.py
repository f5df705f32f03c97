"""Raw readings in the two shapes they are delivered in."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import time as t


def _selected(df: DataFrame, at: str, months: list[date] | None) -> DataFrame:
    kept = df.where(F.col("value").isNotNull())
    return kept if months is None else kept.where(t.in_months(F.col(at), months, t.zoned(kept, at)))


def timescale_readings(readings: DataFrame, months: list[date] | None = None) -> DataFrame:
    """`readings(time, station_id, parameter, value, unit)` -> raw_id, parameter, unit, collected_at, value.

    The month filter stands on the source column itself, so the source can apply it.
    """
    return _selected(readings, "time", months).select(
        F.col("station_id").alias("raw_id"), "parameter", "unit", t.naive(readings, "time").alias("collected_at"), "value"
    )


def dashboard_readings(air_quality_data: DataFrame, months: list[date] | None = None) -> DataFrame:
    """`air_quality_data(...)` -> raw_id, parameter_name, unit, collected_at, value."""
    return _selected(air_quality_data, "collected_at", months).select(
        F.col("station_id").alias("raw_id"),
        "parameter_name",
        "unit",
        t.naive(air_quality_data, "collected_at").alias("collected_at"),
        "value",
    )


def month_bounds(readings: DataFrame, at: str) -> DataFrame:
    """One row: first and last month of a source, both null when it is empty."""
    span = readings.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    return span.select(t.month_of(t.naive(span, "lo")).alias("lo"), t.month_of(t.naive(span, "hi")).alias("hi"))


def day_predicates(column: str, months: list[date], zoned: bool, days: int = 1) -> list[str]:
    """Database predicates that cover each month exactly once in steps of `days` days, each read by a
    task of its own."""
    kind, suffix = ("TIMESTAMPTZ", "+00") if zoned else ("TIMESTAMP", "")
    found = []
    for month in sorted(set(months)):
        end, first = t.next_month(month), month
        while first < end:
            after = min(first + timedelta(days=days), end)
            found.append(
                f"{column} >= {kind} '{first} 00:00:00{suffix}' AND {column} < {kind} '{after} 00:00:00{suffix}' AND value IS NOT NULL"
            )
            first = after
    return found


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    months: list[date],
    zoned: bool,
    properties: dict[str, str] | None = None,
    days: int = 1,
) -> DataFrame:
    """A database table, the given months only, one partition for every `days` days of a month.

    Pass the result to `timescale_readings` or `dashboard_readings`.
    """
    return spark.read.jdbc(
        url,
        table,
        predicates=day_predicates(column, months, zoned, days),
        properties={"fetchsize": "50000", **(properties or {})},
    )
