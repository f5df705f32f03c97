"""What the plans must look like for the jobs to hold up on large data."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.operators import analysis, rollup, series
from hourmark.operators.capped import capped
from hourmark.operators.fact import canonical_fact, fact_by_month, in_key_ranges
from hourmark.plans import catalog, measurements, publish
from hourmark.runtime import is_small, new_path, shared_folder, small_side
from hourmark.sources import readings, tree
from workload import trees
from workload.standins import Inputs


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs.of(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def root(inputs):
    return trees.hist(inputs)


def test_a_window_becomes_partition_and_pushed_filters(spark, root):
    request = measurements.measurements(
        spark, root, today=date(2002, 1, 1), start="1996-03-01", end="1996-06-30", parameter=["A_F"], agg="daily"
    )
    text = plan(request.rows)
    assert "GreaterThanOrEqual(collected_at" in text and "parameter_name" in text.split("PushedFilters")[1].split("\n")[0]
    location = text.split("Location:")[1].split("\n")[0]
    assert "year=1996/month=03/run=" in location and "year=1992" not in location
    schema = text.split("ReadSchema")[1].split("\n")[0]
    assert "city_name" not in schema and "station_name" not in schema
    assert "SortAggregate" not in text and text.count("HashAggregate") >= 2


def test_a_small_cap_is_a_top_k(spark, root):
    rows = tree.scan_tree(spark, root).select(*rollup.RAW_COLUMNS)
    assert "TakeOrderedAndProject" in plan(capped(rows, measurements.RAW_ORDER, 50))


def test_readings_are_not_shuffled_for_a_small_dimension(inputs):
    text = plan(canonical_fact(readings.timescale_readings(inputs.readings()), inputs.station_dim()))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_large_sides_are_not_broadcast(spark):
    rows = spark.range(100)
    assert is_small(rows, 100) and not is_small(rows, 99)
    assert small_side(rows, 99) is rows


def test_months_are_written_after_one_shuffle_and_one_sort(spark, inputs, tmp_path):
    raw = readings.timescale_readings(inputs.hist_readings())
    publish.write_months(fact_by_month(raw, inputs.station_dim()), str(tmp_path / "t"), S.SORT_KEY)
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    text = runs.apply(runs.size() - 1).physicalPlanDescription().split("Initial Plan")[0]
    assert text.count("Sort (") == 1
    assert len(re.findall(r" Exchange \(", text)) == 1
    full = runs.apply(runs.size() - 1).physicalPlanDescription()
    assert "rangepartitioning" in full


def test_summary_reads_the_fact_once_by_hash(spark, root):
    text = plan(series.series_summary(tree.scan_tree(spark, root)))
    assert text.split("\n\n")[0].count("Scan parquet") == 1
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert "value" not in text.split("ReadSchema")[1].split("\n")[0]


def test_sizes_come_from_footers(spark, root):
    text = plan(catalog.file_sizes(tree.scan_tree(spark, root), root, "measurements"))
    assert "ReadSchema: struct<>" in text


def test_pivot_columns_are_given_not_searched(spark, root):
    text = plan(analysis.time_by_station(tree.scan_tree(spark, root), ["site_1", "site_2"]))
    assert "station_id" in text.split("PushedFilters")[1].split("\n")[0]


def test_allowed_years_prune_partitions(spark, root):
    text = plan(tree.visible_years(tree.scan_tree(spark, root), [1996]))
    assert "1996" in text.split("PartitionFilters")[1].split("\n")[0]


def test_work_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        assert shared_folder(spark) == named.rstrip("/")
    assert new_path(spark, "x") != new_path(spark, "x")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_busy_month_is_split_between_tasks(spark, tmp_path):
    """All rows in one month and most at one station: still several tasks write it."""
    import glob

    rows = spark.range(0, 400_000, 1, 16).select(
        F.when(F.col("id") % 3 > 0, F.lit("site_1")).otherwise(F.concat(F.lit("site_"), F.col("id") % 50)).alias("station_id"),
        *[F.lit("x").alias(c) for c in ("station_name", "state_name", "city_name", "parameter_name", "unit")],
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 700).cast("int"))).alias("collected_at"),
        F.rand(1).alias("value"),
        F.lit("x").alias("source"),
        F.lit(2024).alias("year"),
        F.lit("01").alias("month"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        publish.write_months(in_key_ranges(rows), str(tmp_path / "t"), ["station_id", "parameter_name", "collected_at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = glob.glob(str(tmp_path / "t" / "year=2024" / "month=01" / "*.parquet"))
    assert len(files) > 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400_000
