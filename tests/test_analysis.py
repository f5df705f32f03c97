from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from hourmark.operators import analysis, filters, rollup, series

FACT = "station_id string, station_name string, state_name string, city_name string, parameter_name string, unit string, collected_at timestamp_ntz, value double, source string"
NOON = datetime(2024, 1, 1, 12)


def fact(spark, rows):
    """rows of (station, parameter, unit, hours after noon, value)"""
    full = [(s, f"n{s}", "st", "ct", p, u, NOON + timedelta(hours=h), v, "cpcb_caaqm") for s, p, u, h, v in rows]
    return spark.createDataFrame(full, FACT)


def test_unit_of_the_largest_group(spark):
    rows = [(s, "P", "u1", h, 1.0) for s in "ABC" for h in range(5)] + [("D", "P", "u2", h, 1.0) for h in range(6)]
    row = series.parameters_table(series.series_summary(fact(spark, rows))).first()
    assert (row.unit, row.n_stations, row.n_rows) == ("u2", 4, 21)


def test_unit_tie_goes_to_the_greater_text(spark):
    rows = [("A", "P", "ppb", 0, 1.0), ("B", "P", "ppm", 0, 1.0), ("C", "P", None, 0, 1.0), ("C", "P", None, 1, 1.0)]
    assert series.parameters_table(series.series_summary(fact(spark, rows))).first().unit == "ppm"


def test_latest_names(spark):
    rows = [
        ("s", "old", "st", None, "P", "u", NOON, 1.0, "x"),
        ("s", "new", "st", "town", "P", "u", NOON + timedelta(hours=1), 1.0, "x"),
        ("s", None, "st", None, "P", "u2", NOON + timedelta(hours=2), 1.0, "x"),
        ("s", "other", "st", "place", "Q", "u", NOON + timedelta(minutes=90), 1.0, "x"),
    ]
    per_parameter = series.station_parameter_stats(series.series_summary(spark.createDataFrame(rows, FACT)))
    got = {r.parameter_name: r for r in per_parameter.collect()}
    assert (got["P"].station_name, got["P"].city_name, got["P"].n_rows) == ("new", "town", 3)
    row = series.station_stats(per_parameter).first()
    # P was seen last, so its latest non-null name counts
    assert (row.station_name, row.city_name, row.n_rows, row.parameters) == ("new", "town", 4, ["P", "Q"])


def test_two_units_give_two_rows(spark):
    rows = [("s", "P", "a", 0, 1.0), ("s", "P", "b", 0, 3.0), ("s", "P", "a", 0.5, 2.0)]
    got = {r.unit: (r.mean, r.n) for r in rollup.period_rollup(fact(spark, rows), "hourly").collect()}
    assert got == {"a": (1.5, 2), "b": (3.0, 1)}  # half past stays in the hour


def test_rolling_mean_equals_pandas(spark):
    days = [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 14]
    daily = spark.createDataFrame([("c", NOON + timedelta(days=d), float(d * d)) for d in days], "city_name string, day timestamp_ntz, mean double")
    got = [r.rolling for r in analysis.city_rolling_mean(daily).orderBy("day").collect()]
    want = pd.Series([float(d * d) for d in days]).rolling(7, center=True).mean()
    assert [None if g is None else round(g, 9) for g in got] == [None if w != w else round(w, 9) for w in want]


def test_network_mean_averages_repeats_first(spark):
    rows = [("a", "P", "u", 0, 1.0), ("a", "P", "u", 0, 3.0), ("b", "P", "u", 0, 10.0)]
    assert analysis.network_mean_by_time(fact(spark, rows)).first().mean == 6.0
    wide = analysis.time_by_station(fact(spark, rows), ["a", "b", "none"]).first()
    assert (wide["a"], wide["b"], wide["none"]) == (2.0, 10.0, None)


def test_extremes_round_after_ranking(spark):
    placed = spark.createDataFrame(
        [("a", "A", "c", 2.5), ("b", "B", "c", 3.5), ("d", "D", "c", 2.4), ("e", "E", "c", 2.5)],
        "station_id string, station_name string, city_name string, mean double",
    )
    got = [(r["rank"], r.station_id, r["mean"]) for r in analysis.extremes(placed, 2).collect()]
    assert got == [("cleanest", "d", 2.0), ("cleanest", "a", 2.0), ("dirtiest", "b", 4.0), ("dirtiest", "a", 2.0)]


def test_coverage(spark):
    rows = fact(spark, [("a", "P", "u", 0, 1.0), ("a", "Q", "u", 2, 1.0), ("b", "P", "u", 1, 1.0)])
    row = analysis.coverage_by_source(rows).first()
    assert (row.readings, row.stations, row.first, row.last) == (3, 2, NOON, NOON + timedelta(hours=2))


def test_name_search(spark):
    names = spark.createDataFrame([("A_1",), ("AB1",), ("a\\b",), ("100%",)], "station_name string")

    def found(text):
        return {r[0] for r in names.where(filters.name_contains("station_name", text)).collect()}

    assert found("a_1") == {"A_1", "AB1"}
    assert found("\\b") == {"a\\b"}
    assert found("0%") == {"100%"}
    assert found("%") == {"A_1", "AB1", "a\\b", "100%"}


def test_long_lists_are_joined(spark):
    rows = fact(spark, [("a", "P", "u", 0, 1.0), ("b", "P", "u", 0, 1.0)])
    wanted = ["a"] + [f"x{n}" for n in range(600)]
    assert [r.station_id for r in filters.keep_members(rows, "station_id", wanted).collect()] == ["a"]
    assert filters.keep_members(rows, "station_id", None) is rows


def test_sample_is_the_same_every_time(spark):
    stations = spark.range(100).select(F.concat(F.lit("site_"), "id").alias("station_id"))
    first = analysis.station_sample(stations).collect()
    assert len(first) == 5 and first == analysis.station_sample(stations.repartition(7)).collect()


def test_thousands_of_stations_pivot_into_one_map(spark):
    """The ids stay a table, and no aggregate or column is made for each of them."""
    n = F.col("id")
    rows = spark.range(20_000).select(
        F.concat(F.lit("s"), n % 5000).alias("station_id"),
        F.timestamp_add("HOUR", (n / 5000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("collected_at"),
        n.cast("double").alias("value"),
    )
    stations = rows.select("station_id").distinct().where("station_id <> 's7'")
    wide = analysis.means_by_time(rows, stations)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1 and plan.count("collect_list(") == 1 and plan.count("Aggregate") <= 3
    got = wide.collect()
    assert len(got) == 4 and all(len(r.means) == 4999 for r in got)
    listed = ["s1", "s7", "s4999"]
    few = {r.collected_at: (r.s1, r.s7, r.s4999) for r in analysis.opened(wide, listed).collect()}
    narrow = analysis.time_by_station(rows.where("station_id <> 's7'"), listed).collect()
    assert few == {r.collected_at: (r.s1, r.s7, r.s4999) for r in narrow}
