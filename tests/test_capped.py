from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourmark.operators.capped import cap_report, cap_reports, capped, capped_answer, row_cap, tier_max_rows

KEYS = ["station_id", "parameter_name", "collected_at"]


@pytest.mark.parametrize(
    ("tier_max", "limit", "fmt", "cap"),
    [
        (None, None, "json", None),
        (None, 250_000, "json", 200_000),
        (None, 250_000, "csv", 250_000),
        (10_000, 50_000, "csv", 10_000),
        (10_000, None, "csv", 10_000),
        (5_000_000, None, "json", 200_000),
        (100, 7, "parquet", 7),
    ],
)
def test_row_cap(tier_max, limit, fmt, cap):
    assert row_cap(tier_max, limit, fmt) == cap


def test_limits():
    with pytest.raises(ValueError):
        row_cap(None, 0, "csv")
    assert tier_max_rows("full") is None and tier_max_rows("nonsense") == 100_000


@pytest.mark.parametrize(("cap", "rows", "truncated"), [(9, 9, True), (10, 10, False), (11, 10, False), (None, 10, False)])
def test_report(spark, cap, rows, truncated):
    got = cap_report(spark.range(10).toDF("v"), cap).first()
    assert (got.rows, got.truncated, got.max_rows) == (rows, truncated, cap)


@pytest.fixture(scope="module")
def series(spark):
    """One station holds a third of all rows, another third is copies of one row; some keys are null."""
    n = F.col("id")
    times = F.lit(datetime(2024, 1, 1).isoformat(sep=" ")).cast("timestamp_ntz")
    return spark.range(3000).select(
        F.when(n % 3 == 0, F.lit("hot")).when(n % 3 == 1, F.lit("copy")).otherwise(F.concat(F.lit("s"), n % 11)).alias("station_id"),
        F.when(n % 3 == 1, F.lit("p")).when(n % 50 != 0, F.concat(F.lit("p"), n % 4)).alias("parameter_name"),
        F.when(n % 3 == 1, times).otherwise(times + F.make_dt_interval(hours=(n % 700).cast("int"))).alias("collected_at"),
        F.when(n % 3 == 1, F.lit(1.5)).when(n % 70 == 2, F.lit(float("nan"))).otherwise(n / 7.0).alias("value"),
    )


@pytest.mark.parametrize("cap", [1, 42, 500, 999, 1000, 1001, 1500, 2500, 2999, 3000, 5000])
def test_counted_prefix_equals_the_sorted_one(spark, series, cap):
    whole = series.orderBy(*[F.asc_nulls_last(c) for c in [*KEYS, "value"]]).collect()
    got = capped(series, KEYS, cap, top_k_max=0).collect()
    assert [str(r) for r in got] == [str(r) for r in whole[:cap]]
    if cap < 10_000:
        assert [str(r) for r in capped(series, KEYS, cap).collect()] == [str(r) for r in whole[:cap]]


@pytest.mark.parametrize("cap", [None, 500, 1500, 5000])
@pytest.mark.parametrize("top_k_max", [0, 10_000])
def test_rows_and_report_in_one_pass(spark, series, cap, top_k_max):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            calls.add(rows.num_rows)
            yield rows

    watched = series.mapInArrow(counted, series.schema)
    answer = capped_answer(watched, KEYS, cap, top_k_max)
    got = []
    report = answer.deliver(lambda rows: got.extend(rows.collect()))
    assert report == cap_report(series, cap).first().asDict() and report["rows"] == len(got)
    if cap is not None and cap <= top_k_max:
        assert calls.value == 3000  # the result was made once
    assert answer.report.first().asDict() == report


def test_several_caps_count_once(spark, series):
    reports = cap_reports(series, [None, 10, 3000, 2999])
    assert [tuple(r) for r in reports.orderBy("request").collect()] == [(0, 3000, False, None), (1, 10, True, 10), (2, 3000, False, 3000), (3, 2999, True, 2999)]
    plan = reports._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan and "Union" not in plan
