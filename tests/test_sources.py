from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hourmark.operators.stations import first_listed
from hourmark.sources import readings, registry, tree


def test_registry_files(spark, tmp_path):
    first = tmp_path / "a.csv"
    first.write_text(
        "station,state,city,latitude,longitude\n"
        '"Fort, North - X",Tamil_Nadu,  Chennai ,13.1,80.2\n'
        "No Number - X,S,C,abc,1\n"
        "Blank - X,S,C,,1\n"
        '"Quoted ""Q"" - X",,,1.5,2.5\n'
        "Short - X,S,C,1.0\n"
        '"Two\nLines - X",S,C,3,4\n',
        encoding="utf-8",
    )
    second = tmp_path / "b.csv"
    second.write_text("city,longitude,station,latitude\nDelhi,77,\"Fort, North - X\",28\nPune,73,Other,18\n")
    rows = registry.load_registry(spark, [str(first), str(second)], multi_line=True)
    got = {(r.seq["file"], r.full_name): r for r in rows.collect()}
    assert set(got) == {(0, "Fort, North - X"), (0, 'Quoted "Q" - X'), (0, "Two\nLines - X"), (1, "Fort, North - X"), (1, "Other")}
    fort = got[0, "Fort, North - X"]
    assert (fort.state, fort.city, fort.latitude, fort.norm) == ("Tamil Nadu", "Chennai", 13.1, "fortnorth")
    assert got[0, 'Quoted "Q" - X'].state is None and got[1, "Other"].state is None
    kept = {r.full_name: r.city for r in first_listed(rows).collect()}
    assert kept["Fort, North - X"] == "Chennai" and kept["Other"] == "Pune"


def test_registry_keeps_listing_order_within_a_split_file(spark, tmp_path):
    path = tmp_path / "long.csv"
    lines = [f"Same - {n % 50},S,City{n},{n / 1000},0" for n in range(5000)]
    path.write_text("station,state,city,latitude,longitude\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = registry.load_registry(spark, [str(path)], multi_line=False)
        assert rows.rdd.getNumPartitions() > 3
        kept = {r.full_name: r.city for r in first_listed(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert kept == {f"Same - {n}": f"City{n}" for n in range(50)}


def test_portal_file(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("station_id,station_name,state,city,latitude,longitude\n site_1 ,, S_x ,C,1,2\nsite_2,N,S,C,x,2\n")
    (row,) = registry.load_portal(spark, str(path)).collect()
    assert row.asDict() == {
        "station_id": "site_1", "station_name": None, "state": "S_x", "city": "C", "latitude": 1.0, "longitude": 2.0,
    }


def test_fixed_stations(spark):
    rows = registry.fixed_stations(spark).collect()
    assert len(rows) == 5 and all(r.station_id.startswith("DS101") for r in rows)


def test_readings_shapes(spark):
    zoned = spark.sql(
        "SELECT timestamp'2024-01-31 23:30:00Z' AS time, 's' AS station_id, 'O Xylene' AS parameter, 1.0D AS value, 'u' AS unit"
        " UNION ALL SELECT timestamp'2024-02-01 00:00:00Z', 's', 'p', 2.0D, 'u' UNION ALL SELECT timestamp'2024-01-01 00:00:00Z', 's', 'p', NULL, 'u'"
    )
    (row,) = readings.timescale_readings(zoned, [date(2024, 1, 1)]).collect()
    assert row.collected_at == datetime(2024, 1, 31, 23, 30) and row.raw_id == "s"


@pytest.mark.parametrize("days", [1, 7, 40])
def test_predicates_cover_each_month_once(days):
    import re

    months = [date(2023, 12, 1), date(2024, 2, 1), date(2023, 12, 1)]
    got = readings.day_predicates("time", months, zoned=True, days=days)
    assert got[0].startswith("time >= TIMESTAMPTZ '2023-12-01 00:00:00+00' AND time < TIMESTAMPTZ '") and got[0].endswith(" AND value IS NOT NULL")
    spans = [[date.fromisoformat(d) for d in re.findall(r"'(\S+) 00:00:00\+00'", p)] for p in got]
    covered = [a + timedelta(days=k) for a, b in spans for k in range((b - a).days)]
    assert covered == [date(2023, 12, 1) + timedelta(days=k) for k in range(31)] + [date(2024, 2, 1) + timedelta(days=k) for k in range(29)]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_months_do_not_depend_on_the_session_zone(spark, zone):
    """Around both changes of the clock, and at the edges of a month in UTC."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", zone)
    wanted = [datetime(2023, 11, 1, 0, 30), datetime(2023, 11, 5, 5), datetime(2023, 11, 5, 6), datetime(2023, 11, 5, 7), datetime(2023, 11, 30, 23, 59, 59, 999999)]
    others = [datetime(2023, 10, 31, 23, 59), datetime(2023, 12, 1), datetime(2024, 3, 10, 7, 30), datetime(1969, 12, 31, 23, 0, 0, 5)]
    rows = [(str(at) + "+00:00",) for at in wanted + others]
    zoned = session.createDataFrame(rows, "at string").selectExpr("cast(at AS timestamp) AS time", "'s' AS station_id", "'p' AS parameter", "1D AS value", "'u' AS unit")
    november = readings.timescale_readings(zoned, [date(2023, 11, 1)])
    assert sorted(r.collected_at for r in november.collect()) == wanted
    everything = readings.timescale_readings(zoned)
    assert sorted(r.collected_at for r in everything.collect()) == sorted(wanted + others)
    assert tuple(readings.month_bounds(zoned, "time").first()) == (date(1969, 12, 1), date(2024, 3, 1))


def test_the_month_filter_of_instants_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "zoned")
    spark.sql("SELECT timestamp'2024-01-31 23:30:00Z' AS time, 's' AS station_id, 'p' AS parameter, 1.0D AS value, 'u' AS unit").write.parquet(path)
    plan = readings.timescale_readings(spark.read.parquet(path), [date(2024, 1, 1)])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(time" in plan and "LessThan(time" in plan


def test_bounds_of_an_empty_source(spark):
    empty = spark.createDataFrame([], "time timestamp_ntz")
    assert tuple(readings.month_bounds(empty, "time").first()) == (None, None)


def test_partition_predicate(spark):
    months = spark.range(36).select(
        (F.lit(2020) + F.floor(F.col("id") / 12)).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month")
    )

    def kept(first, last):
        return [(r.year, r.month) for r in months.where(tree.months_between(first, last)).orderBy("year", "month").collect()]

    assert kept(date(2020, 11, 30), date(2021, 2, 1)) == [(2020, 11), (2020, 12), (2021, 1), (2021, 2)]
    assert kept(date(2021, 5, 2), date(2021, 6, 1)) == [(2021, 5), (2021, 6)]
    assert len(kept(date(2020, 12, 1), date(2022, 1, 1))) == 14
