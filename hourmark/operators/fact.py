"""Raw readings to the canonical fact."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.functions import text as x
from hourmark.runtime import BROADCAST_MAX_ROWS, cut, is_small, small_side

# Readings that a task writes at most, as far as the expected counts are right, and at least if there are so many.
TASK_ROWS = 4_000_000
LEAST_TASK_ROWS = 50_000


def _published(readings: DataFrame) -> dict[str, Column]:
    """What is published of a reading itself.

    Readings in the timescale shape carry `parameter`, whose spaces become underscores; the
    dashboard shape carries `parameter_name`, taken as it is.
    """
    if "parameter" in readings.columns:
        parameter = x.underscore_spaces(F.col("parameter"))
    else:
        parameter = F.col("parameter_name")
    return {
        "parameter_name": parameter,
        "unit": x.harmonise_unit(F.col("unit")),
        "collected_at": F.col("collected_at").cast("timestamp_ntz"),
        "value": F.col("value").cast("double"),
    }


def canonical_columns(joined: DataFrame) -> DataFrame:
    """The nine published columns of readings already joined to their stations."""
    made = _published(joined)
    return joined.select(*[made[c].alias(c) if c in made else c for c in S.FACT_COLUMNS])


def canonical_fact(readings: DataFrame, station_dim: DataFrame) -> DataFrame:
    """Readings with their station's public id, names and network.

    The readings are far larger than the stations and one station may hold much of them. A small
    dimension is broadcast, so readings stay where they were read; a large one is joined by shuffle,
    where the adaptive skew join splits a hot station.
    """
    names = station_dim.select("raw_id", "station_id", "station_name", "state_name", "city_name", "source")
    return canonical_columns(readings.join(small_side(names), "raw_id"))


def with_month(df: DataFrame) -> DataFrame:
    """Add the partition columns of the published tree, the month as its two digits."""
    return df.withColumns(
        {"year": F.year("collected_at"), "month": F.lpad(F.month("collected_at").cast("string"), 2, "0")}
    )


def in_key_ranges(df: DataFrame) -> DataFrame:
    """Ranges of month, station, parameter and time, one to a task.

    Ranges of the whole key do not overlap, so neither do the files of a month; a month or a station
    that holds most rows is cut by time. A salt, which takes no part in the order of rows, keeps copies
    of one row from ending in one task.
    """
    return df.withColumn("__salt", F.rand(7)).repartitionByRange("year", "month", *S.SORT_KEY, "__salt").drop("__salt")


def fact_by_month(readings: DataFrame, station_dim: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """The canonical fact with its partition columns, in ranges of its key and sorted.

    `expected` says how many readings the series have by month (year, month, station_id, parameter_name, n).
    With it, and a dimension that is small enough to be broadcast, the ranges follow from these counts;
    else Spark finds them by sampling, which reads and joins the readings a second time.
    """
    if expected is not None and is_small(station_dim):
        # readings are dealt as they are read, without names, and named where they are written
        placed = with_month(canonical_fact(in_expected_ranges(readings, station_dim, expected), station_dim))
    else:
        placed = in_key_ranges(with_month(canonical_fact(readings, station_dim)))
    return placed.sortWithinPartitions("year", "month", *S.SORT_KEY)


def key_counts(readings: DataFrame, station_dim: DataFrame) -> DataFrame:
    """(year, month, station_id, parameter_name, n) of raw readings. Reads their keys and times only, and
    sums before the shuffle."""
    named = "parameter" if "parameter" in readings.columns else "parameter_name"
    counts = readings.groupBy("raw_id", named, F.year("collected_at").alias("year"), F.month("collected_at").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ids = counts.join(small_side(station_dim.select("raw_id", "station_id")), "raw_id")
    parameter = x.underscore_spaces(F.col(named)) if named == "parameter" else F.col(named)
    return ids.groupBy("year", "month", "station_id", parameter.alias("parameter_name")).agg(F.sum("n").alias("n"))


def _shares(stations: DataFrame, expected: DataFrame, months: list[tuple[int, int]]) -> DataFrame:
    """(station_id, year, month, share_before, share, shares): of every station, in each of these months, the
    share of the month's readings that stations before it have, its own, and its parameters with the shares
    before and at each. One row per station and month takes part."""
    by_series = expected.groupBy("year", "month", "station_id", "parameter_name").agg(F.sum("n").cast("double").alias("n"))
    by_station = by_series.groupBy("year", "month", "station_id").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("parameter_name", "n"))).alias("parts")
    )
    listed = ", ".join(f"struct({y} AS year, {m} AS month)" for y, m in months)
    everyone = stations.distinct().select("station_id", F.inline(F.expr(f"array({listed})")))
    whole = Window.partitionBy("year", "month")
    before = whole.orderBy("station_id").rowsBetween(Window.unboundedPreceding, -1)
    total = F.greatest(F.sum("n").over(whole), F.lit(1.0))
    summed = lambda upto: F.aggregate(F.slice("parts", 1, upto), F.lit(0.0), lambda a, p: a + p["n"])
    shares = F.transform(
        "parts",
        lambda p, k: F.struct(p["parameter_name"].alias("name"), (summed(k) / F.col("total")).alias("before"), (p["n"] / F.col("total")).alias("share")),
    )
    own, earlier = F.coalesce("n", F.lit(0.0)), F.coalesce(F.sum("n").over(before), F.lit(0.0))
    ranked = everyone.join(by_station, ["year", "month", "station_id"], "left").select(
        "station_id", "year", "month", "parts", total.alias("total"), (earlier / total).alias("share_before"), (own / total).alias("share")
    )
    return ranked.select("station_id", "year", "month", "share_before", "share", shares.alias("shares"))


def in_expected_ranges(readings: DataFrame, station_dim: DataFrame, expected: DataFrame) -> DataFrame:
    """Raw readings dealt to tasks by ranges of month, station, parameter and time.

    Where a reading falls among all is reckoned from the expected counts: the readings of months before,
    then of stations and parameters before in the order of the key, then the time inside the month. That
    rises with the key, so ranges do not overlap whatever the counts are; right counts make them alike.
    A station whose readings of a month are all one task's, as nearly all are, has that looked up; readings
    of others at the same hour are spread at random over their share.
    """
    spark = readings.sparkSession
    expected = cut(expected)
    counted = expected.groupBy("year", "month").agg(F.sum("n").alias("n")).orderBy("year", "month").collect()  # calendar months
    index = lambda y, m: y * 12 + m - 1
    first = index(counted[0].year, counted[0].month) if counted else 0
    sizes = [0] * (index(counted[-1].year, counted[-1].month) - first + 1) if counted else [0]
    for r in counted:
        sizes[index(r.year, r.month) - first] = r.n
    starts = [0, *itertools.accumulate(sizes)][:-1]
    total = sum(sizes)
    of_task = min(TASK_ROWS, max(LEAST_TASK_ROWS, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    tasks = max(1, -(-total // of_task))
    if tasks == 1:
        return readings.repartition(1)

    def task_at(share: Column, number: Column) -> Column:
        of_list = lambda values: F.get(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), number)
        place = of_list(starts) + of_list(sizes) * F.least(share, F.lit(1.0))
        return F.least(F.floor(place / of_task), F.lit(tasks - 1)).cast("int")

    ids = station_dim.select("raw_id", "station_id").distinct()  # readings are dealt once, however often they are described
    shares = _shares(ids.select("station_id"), expected, [(r.year, r.month) for r in counted])
    shares = shares.withColumn("number", F.col("year") * 12 + F.col("month") - 1 - first)
    low, high = task_at(F.col("share_before"), F.col("number")), task_at(F.col("share_before") + F.col("share"), F.col("number"))
    looked_up = shares.withColumn("task", F.when(low == high, low)).withColumn("shares", F.when(F.col("task").isNull(), F.col("shares")))
    looked_up = ids.join(looked_up, "station_id").select(F.col("raw_id").alias("__raw"), F.col("number").alias("__number"), "task", "share_before", "shares")

    at = F.col("collected_at").cast("timestamp_ntz")
    number = F.year(at) * 12 + F.month(at) - 1 - F.lit(first)
    looked_up = F.broadcast(looked_up) if ids.count() * len(counted) <= BROADCAST_MAX_ROWS else cut(looked_up)
    placed = readings.join(looked_up, (F.col("raw_id") == F.col("__raw")) & (number == F.col("__number")), "left")
    parameter = _published(readings)["parameter_name"]
    upto = F.filter("shares", lambda p: p["name"] <= parameter)
    of_month = ((F.dayofmonth(at) - 1) * 24 + F.hour(at) + F.rand(7)) / F.lit(31 * 24.0)
    inside = lambda p: p["before"] + p["share"] * F.when(p["name"] == parameter, of_month).otherwise(F.lit(1.0))
    share = F.coalesce("share_before", F.lit(0.0)) + F.coalesce(inside(F.try_element_at(upto, F.lit(-1))), F.lit(0.0))
    known = F.least(F.greatest(number, F.lit(0)), F.lit(len(sizes) - 1))
    task = F.coalesce("task", task_at(share, known))
    return placed.withColumn("__task", task).repartitionById(tasks, F.col("__task")).select(*readings.columns)
