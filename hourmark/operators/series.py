"""Station and parameter tables, all derived from one summary of the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark import schema as S


def series_summary(fact: DataFrame, *extra: str) -> DataFrame:
    """Rows, first and last reading per series and the names it was published under.

    The names are grouped by, not aggregated: a series has few of them, and with numbers and times
    as the only aggregates Spark can aggregate by hash before the shuffle. It is the only pass over
    the readings; every table below is made from its result, and summaries of single months add up.
    """
    return fact.groupBy(*extra, *S.SERIES_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("collected_at").alias("first_seen"),
        F.max("collected_at").alias("last_seen"),
    )


def _latest(name: str, at: str) -> Column:
    """The non-null `name` with the greatest `at`, the greater name on a tie."""
    return F.max(F.when(F.col(name).isNotNull(), F.struct(at, name)))[name].alias(name)


def station_parameter_stats(summary: DataFrame) -> DataFrame:
    """Per station and parameter: latest names, span and number of readings."""
    return summary.groupBy("station_id", "parameter_name").agg(
        _latest("station_name", "last_seen"),
        _latest("state_name", "last_seen"),
        _latest("city_name", "last_seen"),
        F.max("source").alias("source"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("n").alias("n_rows"),
    )


def station_stats(per_parameter: DataFrame) -> DataFrame:
    """Per station, from `station_parameter_stats`, with the sorted list of its parameters.

    The list holds one name per parameter, never one per reading.
    """
    return per_parameter.groupBy("station_id").agg(
        _latest("station_name", "last_seen"),
        _latest("state_name", "last_seen"),
        _latest("city_name", "last_seen"),
        F.max("source").alias("source"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("n_rows").alias("n_rows"),
        F.sort_array(F.collect_list("parameter_name")).alias("parameters"),
    )


def one_per_public_id(station_dim: DataFrame) -> DataFrame:
    return station_dim.groupBy("station_id").agg(
        *[F.max(c).alias(c) for c in ("station_name", "state_name", "city_name", "latitude", "longitude")]
    )


def stations_table(summary: DataFrame, station_dim: DataFrame, each_description: bool = False) -> DataFrame:
    """The published station table: stations with readings, described by the current dimension; a row
    per station or, with `each_description`, per station and description."""
    stats = station_stats(station_parameter_stats(summary)).alias("s")
    dim = (station_dim if each_description else one_per_public_id(station_dim)).alias("d")
    return stats.join(dim, "station_id", "left").select(
        "station_id",
        *[F.coalesce(f"d.{c}", f"s.{c}").alias(c) for c in ("station_name", "state_name", "city_name")],
        "s.source",
        "d.latitude",
        "d.longitude",
        "s.first_seen",
        "s.last_seen",
        "s.n_rows",
        "s.parameters",
    )


def parameters_table(summary: DataFrame) -> DataFrame:
    """The published parameter table.

    The unit is that of the largest single (unit, station) group, not the commonest overall.
    """
    groups = summary.groupBy("parameter_name", "unit", "station_id").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    largest = F.max(F.when(F.col("unit").isNotNull(), F.struct("n", "unit")))
    return groups.groupBy("parameter_name").agg(
        largest["unit"].alias("unit"),
        F.count_distinct("station_id").alias("n_stations"),
        F.sum("n").alias("n_rows"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def in_listing_order(stations: DataFrame) -> DataFrame:
    order = ["source", "state_name", "city_name", "station_name"]
    return stations.orderBy(*[F.asc_nulls_last(c) for c in order], "station_id")


def by_size(parameters: DataFrame) -> DataFrame:
    return parameters.orderBy(F.desc("n_rows"), "parameter_name")
