"""Analysis over the fact: coverage, means, daily cycles, rolling means, pivots and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.functions import time as t
from hourmark.operators.filters import plausible


def of_parameter(fact: DataFrame, parameter: str, low: float = 0, high: float = 1000) -> DataFrame:
    """Readings of one parameter within the plausible range."""
    return fact.where((F.col("parameter_name") == parameter) & plausible(low, high))


def coverage_by_source(fact: DataFrame) -> DataFrame:
    """Readings, stations and time span of each network.

    Stations are counted from one row per station, since two networks are too few groups to share
    out the work.
    """
    stations = fact.groupBy("source", "station_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("collected_at").alias("first"),
        F.max("collected_at").alias("last"),
    )
    return stations.groupBy("source").agg(
        F.sum("n").alias("readings"),
        F.count("station_id").alias("stations"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def city_daily_mean(fact: DataFrame, cities: list[str]) -> DataFrame:
    return (
        fact.where(F.col("city_name").isin(cities))
        .groupBy("city_name", t.period_start(F.col("collected_at"), "daily").alias("day"))
        .agg(F.avg("value").alias("mean"))
    )


def centred_mean(by: str, order: str, value: str, rows: int = 7) -> Column:
    """Mean of the row and its neighbours in `order`, null until all `rows` are there.

    The frame counts rows, not days: a missing day widens the span it covers.
    """
    half = rows // 2
    frame = Window.partitionBy(by).orderBy(order).rowsBetween(-half, half)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def city_rolling_mean(daily: DataFrame, rows: int = 7) -> DataFrame:
    """`city_daily_mean` with its centred mean; a city has one row per day, so its window is short."""
    return daily.withColumn("rolling", centred_mean("city_name", "day", "mean", rows))


def diurnal_cycle(fact: DataFrame, cities: list[str]) -> DataFrame:
    return (
        fact.where(F.col("city_name").isin(cities))
        .groupBy("city_name", F.hour("collected_at").alias("hr"))
        .agg(F.avg("value").alias("mean"))
    )


def hour_by_city(cycle: DataFrame, cities: list[str]) -> DataFrame:
    """The daily cycle with one column per city."""
    return cycle.groupBy("hr").pivot("city_name", cities).agg(F.max("mean"))


def station_means(fact: DataFrame, min_readings: int = 500) -> DataFrame:
    """Mean per station, stations with more than `min_readings` readings."""
    means = fact.groupBy("station_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.where(F.col("n") > min_readings)


def with_place(means: DataFrame, stations: DataFrame) -> DataFrame:
    """Station means with name, city and coordinates; stations without a latitude are dropped."""
    places = stations.where(F.col("latitude").isNotNull()).select(
        "station_id", "station_name", "city_name", "latitude", "longitude"
    )
    return means.join(places, "station_id")


def extremes(placed_means: DataFrame, count: int = 10) -> DataFrame:
    """The lowest and the highest station means, labelled; rounded after ranking, half to even."""
    low = placed_means.orderBy(F.asc("mean"), "station_id").limit(count)
    high = placed_means.orderBy(F.desc("mean"), "station_id").limit(count)
    both = low.withColumn("rank", F.lit("cleanest")).unionByName(high.withColumn("rank", F.lit("dirtiest")))
    return both.select("rank", "station_id", "station_name", "city_name", F.bround("mean", 0).alias("mean"))


def city_month_mean(fact: DataFrame, digits: int = 1) -> DataFrame:
    """Mean per city and month number, on the partition column."""
    return fact.groupBy("city_name", "month").agg(F.round(F.avg("value"), digits).alias("mean"))


def station_day_mean(fact: DataFrame) -> DataFrame:
    return fact.groupBy("station_id", t.period_start(F.col("collected_at"), "daily").alias("day")).agg(
        F.avg("value").alias("mean")
    )


def station_mean(fact: DataFrame) -> DataFrame:
    return fact.groupBy("station_id").agg(F.avg("value").alias("mean"))


def network_mean_by_time(fact: DataFrame) -> DataFrame:
    """Mean over the stations that reported at each time, repeated readings averaged first."""
    per_station = fact.groupBy("collected_at", "station_id").agg(F.avg("value").alias("mean"))
    return per_station.groupBy("collected_at").agg(F.avg("mean").alias("mean"))


def time_by_station(fact: DataFrame, stations: list[str]) -> DataFrame:
    """Readings with one column per listed station, repeated readings averaged."""
    return (
        fact.where(F.col("station_id").isin(stations))
        .groupBy("collected_at")
        .pivot("station_id", stations)
        .agg(F.avg("value"))
    )


def means_by_time(fact: DataFrame, stations: DataFrame) -> DataFrame:
    """The same for the stations of a table, of any number: (collected_at, means), a map from station to mean.

    The ids stay a table, and there is one aggregate, not one for each of them.
    """
    means = fact.join(stations.select("station_id").distinct(), "station_id", "left_semi").groupBy("collected_at", "station_id").agg(
        F.avg("value").alias("mean")
    )
    entries = F.collect_list(F.struct("station_id", "mean"))  # one of a station
    return means.groupBy("collected_at").agg(F.map_from_entries(entries).alias("means"))


def opened(by_time: DataFrame, stations: list[str]) -> DataFrame:
    """`means_by_time` with the columns of some stations."""
    return by_time.select("collected_at", *[F.try_element_at("means", F.lit(s)).alias(s) for s in stations])


def city_stations(stations: DataFrame, city: str) -> DataFrame:
    return stations.where(F.lower("city_name") == city.lower()).select("station_id").distinct()


def stations_of_city(stations: DataFrame, city: str) -> list[str]:
    """Ids of a city's stations in order, for the columns of a pivot: as many as a table can have."""
    return [row.station_id for row in city_stations(stations, city).orderBy("station_id").collect()]


def station_sample(stations: DataFrame, count: int = 5, seed: int = 1) -> DataFrame:
    """A fixed sample: the stations whose seeded digest comes first."""
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col("station_id")).cast("binary"))
    return stations.orderBy(lot, "station_id").limit(count)
