from datetime import date

import pytest
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.functions import time as t
from hourmark.operators import filters, series
from hourmark.operators.fact import fact_by_month, key_counts
from hourmark.operators.stations import DuplicateStations
from hourmark.plans import catalog, measurements, publish
from hourmark.sources import readings, tree

JAN, FEB, MAR, DEC = date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1), date(2023, 12, 1)


def source(spark, months, bump=0.0, per_month=300):
    rows = spark.range(len(months) * per_month).select(F.col("id"), F.element_at(F.lit(months), (F.col("id") % len(months) + 1).cast("int")).alias("m"))
    n = F.col("id")
    return rows.select(
        (F.col("m").cast("timestamp_ntz") + F.make_dt_interval(hours=(n * 7 % 600).cast("int"))).alias("time"),
        F.concat(F.lit("site_"), n % 9, F.when(n % 9 == 4, F.lit("_Name")).otherwise(F.lit(""))).alias("station_id"),
        F.when(n % 2 == 0, F.lit("O Xylene")).otherwise(F.lit("CO")).alias("parameter"),
        F.when(n % 40 != 0, n + F.lit(bump)).cast("double").alias("value"),
        F.when(n % 3 == 0, F.lit(" UG/M3")).otherwise(F.lit("ppb")).alias("unit"),
    )


def dimension(spark, label="Name"):
    n = F.col("id")
    raw = F.concat(F.lit("site_"), n, F.when(n == 4, F.lit("_Name")).otherwise(F.lit("")))
    return spark.range(9).select(
        raw.alias("raw_id"),
        F.concat(F.lit("site_"), n).alias("station_id"),
        F.concat(F.lit(label), n).alias("station_name"),
        F.lit("State").alias("state_name"),
        F.concat(F.lit("City "), n % 2).alias("city_name"),
        n.cast("double").alias("latitude"),
        F.when(n != 3, n.cast("double")).alias("longitude"),
        F.lit(S.MAIN_NETWORK).alias("source"),
    )


def run(spark, root, data, months, label="Name", stamp="2024-03-31T00:00:00+00:00"):
    frame = spark.createDataFrame([(m,) for m in months], "month date")
    return publish.publish(spark, root, lambda asked: readings.timescale_readings(data, asked), dimension(spark, label), frame, stamp)


def rows_of(df):
    return sorted(str(r.asDict()) for r in df.collect())


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "out")


def test_round_trip(spark, root):
    data = source(spark, [DEC, JAN, FEB])
    made = run(spark, root, data, [DEC, JAN, FEB])
    assert made.months == [DEC, JAN, FEB] and made.removed == []
    fact = tree.scan_tree(spark, root)
    assert fact.schema == S.FACT
    kept = data.where("value IS NOT NULL")
    assert fact.count() == kept.count()
    assert fact.where("year <> year(collected_at) OR month <> month(collected_at)").count() == 0
    assert {r.unit for r in fact.select("unit").distinct().collect()} == {"µg/m³", "ppb"}
    assert {r.station_id for r in fact.select("station_id").distinct().collect()} == {f"site_{n}" for n in range(9)}
    listed = {r.key: r.rows for r in tree.manifest_months(made.manifest).collect()}
    assert sum(listed.values()) == fact.count()
    assert set(listed) == {tree.month_key(2023, 12), tree.month_key(2024, 1), tree.month_key(2024, 2)}
    summary = catalog.coverage_summary(made.manifest).first()
    assert (summary.first_month, summary.last_month, summary.stations, summary.parameters) == ("2023-12", "2024-02", 9, 2)
    stations = tree.read_stations(spark, root)
    assert stations.columns == [
        "station_id", "station_name", "state_name", "city_name", "source", "latitude", "longitude", "first_seen", "last_seen", "n_rows", "parameters",
    ]
    assert stations.agg(F.sum("n_rows")).first()[0] == fact.count()
    assert stations.first().parameters == ["CO", "O_Xylene"]


def test_files_are_sorted_and_cut_into_row_groups(spark, root):
    import glob

    import pyarrow.parquet as pq

    raw = readings.timescale_readings(source(spark, [JAN], per_month=5000))
    publish.write_months(fact_by_month(raw, dimension(spark)), root, S.SORT_KEY, row_group=1000)
    files = glob.glob(f"{root}/year=2024/month=01/*.parquet")
    assert files
    for path in files:
        file = pq.ParquetFile(path)
        assert file.metadata.row_group(0).column(0).compression == "ZSTD"
        table = file.read().to_pylist()
        keys = [(r["station_id"], r["parameter_name"], r["collected_at"]) for r in table]
        assert keys == sorted(keys)
    assert sum(pq.ParquetFile(p).num_row_groups for p in files) >= 4


def test_files_of_a_month_do_not_overlap(spark, root):
    """One station holds most rows of the month and is cut by time."""
    import glob

    import pyarrow.parquet as pq

    n = F.col("time")
    data = source(spark, [JAN], per_month=20_000).withColumn("station_id", F.when(F.hash(n) % 10 != 0, F.lit("site_1")).otherwise(F.col("station_id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        raw = readings.timescale_readings(data.distinct())
        publish.write_months(fact_by_month(raw, dimension(spark)), root, S.SORT_KEY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = []
    for path in glob.glob(f"{root}/year=2024/month=01/*.parquet"):
        keys = [(r["station_id"], r["parameter_name"], r["collected_at"]) for r in pq.ParquetFile(path).read().to_pylist()]
        spans.append((min(keys), max(keys)))
    spans.sort()
    assert len(spans) > 2
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("known", ["right", "other", "nothing"])
def test_ranges_by_expected_counts_do_not_overlap(spark, root, monkeypatch, known):
    """The same with counts instead of samples: right ones, those of other months and stations, and none."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr("hourmark.operators.fact.LEAST_TASK_ROWS", 1000)
    n = F.col("time")
    data = source(spark, [JAN, FEB], per_month=12_000).withColumn("station_id", F.when(F.hash(n) % 10 != 0, F.lit("site_1")).otherwise(F.col("station_id")))
    raw = readings.timescale_readings(data.distinct())
    counts = key_counts(raw, dimension(spark))
    if known == "other":
        counts = counts.where("station_id <> 'site_1' AND parameter_name = 'CO' AND month = 1")
    elif known == "nothing":
        counts = counts.limit(0)
    made = fact_by_month(raw, dimension(spark), counts)
    publish.write_months(made, root, S.SORT_KEY)
    assert rows_of(spark.read.schema(S.FACT).parquet(root)) == rows_of(fact_by_month(raw, dimension(spark)).withColumn("month", F.col("month").cast("int")).select(*S.FACT.fieldNames()))
    for month in ("01", "02"):
        spans = []
        for path in glob.glob(f"{root}/year=2024/month={month}/*.parquet"):
            keys = [(r["station_id"], r["parameter_name"], r["collected_at"]) for r in pq.ParquetFile(path).read().to_pylist()]
            assert keys == sorted(keys)
            spans.append((min(keys), max(keys), len(keys)))
        spans.sort()
        if known == "right":  # the hot station is cut by time, into like parts
            assert len(spans) >= 5 and max(s[2] for s in spans) < 2500
        assert all(a[1][:2] < b[0][:2] or a[1][2].replace(minute=0) <= b[0][2] for a, b in zip(spans, spans[1:]))


def test_expected_counts_come_from_what_was_published(spark, root):
    run(spark, root, source(spark, [JAN]), [JAN])
    old = tree.load_manifest(spark, root)
    raw = readings.timescale_readings(source(spark, [JAN, FEB]))
    again = publish._expected(spark, root, old, [JAN, FEB], raw, dimension(spark))
    counts = {(r.year, r.month): r.n for r in again.groupBy("year", "month").agg(F.sum("n").alias("n")).collect()}
    january = tree.month_entries(old)[0]["rows"]
    assert counts == {(2024, 1): january, (2024, 2): january}
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert "value" not in plan and "Range" not in plan  # the source is not read
    counted = publish._expected(spark, root, old, [DEC], readings.timescale_readings(source(spark, [DEC])), dimension(spark))
    assert counted.agg(F.sum("n")).first()[0] == source(spark, [DEC]).where("value IS NOT NULL").count()


def test_a_large_dimension_is_joined_by_shuffle_with_the_same_result(spark, monkeypatch):
    raw = readings.timescale_readings(source(spark, [JAN, FEB]))
    wanted = rows_of(fact_by_month(raw, dimension(spark)))
    monkeypatch.setattr("hourmark.operators.fact.small_side", lambda df: df)
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    try:
        shuffled = fact_by_month(raw, dimension(spark))
        assert rows_of(shuffled) == wanted
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().toString()
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)


class Stop(Exception):
    pass


@pytest.mark.parametrize(("step", "before"), [("write_months", False), ("write_dimensions", False), ("write_manifest", True), ("delete_folders", True)])
def test_a_run_that_stops_leaves_the_tree_readable(spark, root, monkeypatch, step, before):
    run(spark, root, source(spark, [JAN, FEB, MAR]), [JAN, FEB, MAR])
    old = rows_of(tree.scan_tree(spark, root)), rows_of(tree.read_stations(spark, root))
    changed = source(spark, [JAN, FEB, MAR], bump=0.5).where("month(time) <> 3")
    real, calls = getattr(publish, step), []

    def stopping(*args, **kwargs):
        calls.append(step)
        if step == "delete_folders" and len(calls) == 1:  # what an earlier run left behind goes first
            return real(*args, **kwargs)
        if not before:
            real(*args, **kwargs)
        raise Stop

    with monkeypatch.context() as patched, pytest.raises(Stop):
        patched.setattr(publish, step, stopping)
        run(spark, root, changed, [FEB, MAR], label="Other")
    switched = step == "delete_folders"
    now = rows_of(tree.scan_tree(spark, root)), rows_of(tree.read_stations(spark, root))
    assert (now == old) is not switched
    summary = rows_of(publish.published_series(spark, root))
    assert summary == rows_of(series.series_summary(tree.scan_tree(spark, root)))
    # the next run sets everything right, in the tree and in its folders
    made = run(spark, root, changed, [FEB, MAR], label="Other")
    assert made.months == [FEB] and tree.scan_months(spark, root, FEB, FEB).where("value = floor(value)").count() == 0
    stations = tree.read_stations(spark, root)
    assert stations.agg(F.sum("n_rows")).first()[0] == tree.scan_tree(spark, root).count()
    assert all(r.station_name.startswith("Other") for r in stations.collect())
    (named,) = [m for m in tree.month_entries(tree.load_manifest(spark, root)) if m["month"] == 2]
    for kind, folder in (("measurements", named["folder"]), ("series", named["series"])):
        assert publish.run_folders(spark, root, publish.month_folder(kind, FEB)) == [folder]
    assert len(publish.run_folders(spark, root, publish.year_folder(2024))) == len(publish.run_folders(spark, root, publish.table_folder("stations"))) == 1


def test_a_wrong_summary_is_made_again(spark, root):
    import glob
    import os

    run(spark, root, source(spark, [JAN, FEB]), [JAN, FEB])
    wanted = rows_of(tree.read_stations(spark, root))
    january = tree.month_entries(tree.load_manifest(spark, root))[0]
    (path,) = glob.glob(f"{root}/{january['series']}/*.parquet")
    wrong = spark.read.parquet(path).withColumn("n", F.col("n") + 5)
    wrong.write.parquet(f"{root}/wrong")
    os.replace(glob.glob(f"{root}/wrong/*.parquet")[0], path)
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    run(spark, root, source(spark, [JAN, FEB]), [FEB])
    assert rows_of(tree.read_stations(spark, root)) == wanted
    assert tree.month_entries(tree.load_manifest(spark, root))[0]["series"] != january["series"]


def test_a_run_opens_only_what_it_touches(spark, root):
    """A tree of 80 months; all files of months that a one-month run has no business with are made unreadable."""
    import glob

    months = [t.next_month(date(2017, 5, 1), k) for k in range(80)]
    data = source(spark, months, per_month=20)
    published = run(spark, root, data, months).months  # two of the months have no value
    last = months[-1]
    spoilt = [f for f in glob.glob(f"{root}/v1/measurements/*/*/*/*.parquet") if f"year={last.year}/month={last.month:02d}/" not in f]
    spoilt += [f for f in glob.glob(f"{root}/v1/series/*/*/*/*.parquet") if f"year={last.year}/" not in f]
    assert len(published) == 78 and len(spoilt) >= 77 + 60
    for path in spoilt:
        with open(path, "wb") as file:
            file.write(b"not a table")
    made = run(spark, root, source(spark, months, bump=0.5, per_month=20), [last], label="Other")
    assert made.months == [last] and len(tree.month_entries(tree.load_manifest(spark, root))) == 78
    assert tree.scan_months(spark, root, last, last).where("value = floor(value)").count() == 0
    stations = tree.read_stations(spark, root)
    assert stations.agg(F.sum("n_rows")).first()[0] == data.where("value IS NOT NULL").count()


def test_a_scan_is_given_a_path_per_month_not_the_files(spark, root):
    """Ten thousand files in three months."""
    import glob
    import os

    run(spark, root, source(spark, [DEC, JAN, FEB]), [DEC, JAN, FEB])
    rows = 0
    for m in tree.month_entries(tree.load_manifest(spark, root)):
        (path,) = glob.glob(f"{root}/{m['folder']}/*.parquet")
        for k in range(3334):
            os.link(path, f"{os.path.dirname(path)}/copy-{k}.parquet")
        rows += m["rows"] * 3335
    fact = tree.scan_tree(spark, root)
    location = fact._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    assert location.rootPaths().size() == 3
    assert len(fact.inputFiles()) == 3 * 3335
    assert tree.scan_months(spark, root, JAN, FEB).limit(1).count() == 1
    assert len(tree.month_entries(tree.load_manifest(spark, root))) == 3


def test_a_batch_is_published_once(spark, root):
    data = source(spark, [JAN])
    months = spark.createDataFrame([(JAN,)], "month date")
    asked = []

    def readings_of(listed):
        asked.append(listed)
        return readings.timescale_readings(data, listed)

    for name, number, calls in (("a", 3, 1), ("a", 3, 1), ("a", 2, 1), ("b", 0, 2), ("a", 4, 3)):
        publish.publish(spark, root, readings_of, dimension(spark), months, batch=(name, number))
        assert len(asked) == calls
    run(spark, root, data, [JAN])
    assert tree.load_manifest(spark, root)["batches"] == {"a": 4, "b": 0}


def test_second_run_replaces_chosen_months_only(spark, root):
    run(spark, root, source(spark, [JAN, FEB, MAR]), [JAN, FEB, MAR])
    january = rows_of(tree.scan_months(spark, root, JAN, JAN))
    changed = source(spark, [JAN, FEB, MAR], bump=0.5).where("month(time) <> 3")
    made = run(spark, root, changed, [FEB, MAR])
    assert made.months == [FEB] and made.removed == [MAR]
    assert rows_of(tree.scan_months(spark, root, JAN, JAN)) == january
    assert tree.scan_months(spark, root, MAR, MAR).count() == 0
    february = tree.scan_months(spark, root, FEB, FEB)
    assert february.where("value = floor(value)").count() == 0
    assert [(r.year, r.month) for r in tree.manifest_months(made.manifest).collect()] == [(2024, 1), (2024, 2)]
    # the kept summaries still add up to what the files say
    from_files = series.series_summary(tree.scan_tree(spark, root))
    assert rows_of(publish.published_series(spark, root)) == rows_of(from_files)
    # and running it again changes nothing
    before = rows_of(tree.scan_tree(spark, root)), rows_of(tree.read_stations(spark, root)), rows_of(tree.read_parameters(spark, root))
    run(spark, root, changed, [FEB, MAR])
    assert before == (rows_of(tree.scan_tree(spark, root)), rows_of(tree.read_stations(spark, root)), rows_of(tree.read_parameters(spark, root)))


def test_readings_of_other_months_are_not_written(spark, root):
    data = source(spark, [JAN, FEB])
    run(spark, root, data, [JAN, FEB])
    before = rows_of(tree.scan_tree(spark, root))
    stray = data.where("month(time) = 1 OR value > 550")
    months = spark.createDataFrame([(JAN,)], "month date")
    made = publish.publish(spark, root, lambda _: readings.timescale_readings(stray), dimension(spark), months)
    assert made.months == [JAN]
    assert rows_of(tree.scan_tree(spark, root)) == before


def test_dimension_run_leaves_months_alone(spark, root):
    run(spark, root, source(spark, [JAN]), [JAN])
    before = rows_of(tree.scan_tree(spark, root))
    made = run(spark, root, source(spark, [JAN]), [], label="Renamed")
    assert made.months == []
    assert rows_of(tree.scan_tree(spark, root)) == before
    assert all(r.station_name.startswith("Renamed") for r in tree.read_stations(spark, root).collect())


def test_summary_is_rebuilt_when_missing(spark, root):
    run(spark, root, source(spark, [JAN, FEB]), [JAN, FEB])
    wanted = rows_of(tree.read_stations(spark, root))
    for lost in ([tree.series_path], [tree.series_years_path], [tree.series_path, tree.series_years_path]):
        for path in lost:
            publish.delete(spark, path(root))
        run(spark, root, source(spark, [JAN]), [])
        assert rows_of(tree.read_stations(spark, root)) == wanted


def test_duplicate_ids_stop_the_run_before_anything_is_written(spark, root):
    twice = dimension(spark).unionByName(dimension(spark).withColumn("raw_id", F.concat("raw_id", F.lit("_x"))))
    with pytest.raises(DuplicateStations):
        publish.publish(spark, root, lambda _: None, twice, spark.createDataFrame([(JAN,)], "month date"))
    assert not publish.exists(spark, root)


def test_requests_over_the_tree(spark, root):
    run(spark, root, source(spark, [DEC, JAN, FEB]), [DEC, JAN, FEB])
    fact = tree.scan_tree(spark, root).where("value IS NOT NULL")
    result = measurements.measurements(
        spark, root, today=date(2024, 2, 29), start="2024-01-01", end="2024-02-29", agg="monthly", city="CITY 1", parameter=["CO"], fmt="csv"
    )
    rows = result.rows.collect()
    assert [r.station_id for r in rows] == sorted(r.station_id for r in rows)
    assert sum(r.n for r in rows) == fact.where("city_name = 'City 1' AND parameter_name = 'CO' AND year = 2024").count()
    assert measurements.measurements(spark, root, today=date(2030, 1, 1)).rows.count() == 0
    demo = measurements.measurements(spark, root, today=date(2024, 2, 29), start="2023-12-01", tier="demo", limit=5)
    assert len(demo.rows.collect()) == 5 and demo.report.first().truncated
    assert [r.station_id for r in measurements.stations(spark, root, q="name%4").rows.collect()] == ["site_4"]
    assert measurements.stations(spark, root, q="\\").rows.count() == 0
    assert measurements.parameters(spark, root).rows.count() == 2
    few = measurements.stations(spark, root, cap=3)
    assert few.rows.count() == 3 and tuple(few.report.first()) == (3, True, 3)
    assert tuple(measurements.parameters(spark, root).report.first()) == (2, False, S.PARAMETERS_CAP)


def test_a_city_is_found_through_the_names_its_months_were_published_with(spark, root):
    run(spark, root, source(spark, [JAN]), [JAN])
    moved = dimension(spark).withColumn("city_name", F.when(F.col("station_id") == "site_2", F.lit("City 9")).otherwise(F.col("city_name")))
    months = spark.createDataFrame([(FEB,)], "month date")
    publish.publish(spark, root, lambda m: readings.timescale_readings(source(spark, [FEB]), m), moved, months)
    fact = tree.scan_tree(spark, root)
    for city in ("city 0", "city 9", "nowhere"):
        got = measurements.measurements(spark, root, today=date(2024, 2, 29), start="2024-01-01", city=city, fmt="csv").rows
        assert got.count() == fact.where(F.lower("city_name") == city).count()
    plan = measurements.measurements(spark, root, today=date(2024, 2, 29), start="2024-01-10", city="city 0", fmt="csv").rows._jdf.queryExecution().toString()
    assert "In(station_id, [" in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_many_matching_stations_still_prune(spark, root, monkeypatch):
    """Two thousand matching stations among 20,000: row groups without them are not read."""
    n = F.col("id")
    rows = spark.range(20_000).select(
        F.format_string("s%05d", n).alias("station_id"), F.lit("name").alias("station_name"), F.lit("x").alias("state_name"),
        F.when((n >= 9000) & (n < 11000), F.lit("Here")).otherwise(F.lit("There")).alias("city_name"), F.lit("CO").alias("parameter_name"), F.lit("ppb").alias("unit"),
        F.lit("2024-01-05 00:00:00").cast("timestamp_ntz").alias("collected_at"), n.cast("double").alias("value"), F.lit(S.MAIN_NETWORK).alias("source"),
        F.lit(2024).alias("year"), F.lit("01").alias("month"),
    )
    publish.write_months(rows.coalesce(1), f"{root}/t", S.SORT_KEY, row_group=500)
    fact = spark.read.schema(S.FACT).parquet(f"{root}/t")
    series_rows = fact.select("station_id", "city_name")
    found = tree.matching_stations(series_rows, F.col("city_name") == "Here")
    kept = filters.keep_found(fact, "station_id", found, series_rows)
    listed = filters.keep_members(fact, "station_id", [f"s{k:05d}" for k in range(9000, 11000)])
    for df in (kept, listed):
        assert df.count() == 2000 and scanned(df) <= 3000
    # a few far from each other, and no more ranges than allowed
    odd = series_rows.where("substring(station_id, -2) = '07' OR station_id < 's00600'").select("station_id")
    ranges = [(r.low, r.high) for r in filters.ranges_of(odd, series_rows, "station_id", 5).collect()]
    assert len(ranges) == 5 and min(ranges)[0] == "s00000"
    assert fact.where(filters.in_ranges("station_id", ranges)).join(odd, "station_id", "left_semi").count() == odd.count()


def scanned(df):
    """Rows that the scan of a plan has put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan
    leaves = plan.collectLeaves()
    counts = []
    for k in range(leaves.size()):
        node = leaves.apply(k)
        while node.getClass().getSimpleName().endswith("QueryStageExec"):
            inner = node.plan().collectLeaves()
            node = inner.apply(0)
        if "FileSourceScan" in node.getClass().getSimpleName():
            counts.append(node.metrics().apply("numOutputRows").value())
    return max(counts)


def test_properties_of_rollups(spark, root):
    run(spark, root, source(spark, [JAN, FEB]), [JAN, FEB])
    fact = tree.scan_tree(spark, root)
    rolled = {grain: measurements.period_rollup(fact, grain) for grain in t.GRAINS}
    for frame in rolled.values():
        assert frame.agg(F.sum("n")).first()[0] == fact.count()
    least = rolled["hourly"].groupBy("station_id", "parameter_name", "unit", F.trunc("period_start", "MM").alias("m")).agg(
        F.min("min").alias("least"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("weighted")
    )
    monthly = rolled["monthly"].withColumn("m", F.col("period_start").cast("date"))
    both = least.join(monthly, ["station_id", "parameter_name", "unit", "m"])
    assert both.count() == monthly.count()
    assert both.where((F.col("least") != F.col("min")) | (F.abs(F.col("weighted") - F.col("mean")) > 1e-9)).count() == 0


def test_catalogue(spark, root):
    made = run(spark, root, source(spark, [DEC, JAN, FEB]), [DEC, JAN, FEB])
    listed = catalog.files_catalog(made.manifest)
    assert [r.kind for r in listed.collect()] == ["stations", "parameters"] + ["measurements"] * 3
    assert listed.where("bytes IS NULL OR bytes <= 0").count() == 0
    open_keys = {r.key for r in catalog.visible_files(listed, [2023]).collect()}
    assert open_keys == {"v1/stations.parquet", "v1/parameters.parquet", "v1/measurements/year=2023/month=12"}
    months = tree.manifest_months(made.manifest)
    wide = {r.measure: r for r in catalog.size_across_years(months, [2023, 2024]).collect()}
    assert wide["rows"]["2023"] + wide["rows"]["2024"] == tree.scan_tree(spark, root).count()
    visible = tree.visible_years(tree.scan_tree(spark, root), [2024])
    assert {r.year for r in visible.select("year").distinct().collect()} == {2024}
    expected = t.calendar(spark, date(2024, 4, 1), since="2023-11")
    gaps = {r.month: r.present for r in catalog.missing_months(expected, months).collect()}
    assert [m for m, present in gaps.items() if not present] != [] and sum(gaps.values()) == 3


def test_answer_files(spark, root, tmp_path):
    import json

    run(spark, root, source(spark, [JAN]), [JAN])
    result = measurements.measurements(spark, root, today=date(2024, 1, 31), agg="daily", limit=3)
    meta = measurements.write_answer(result, str(tmp_path / "a"), "json")
    assert (meta["rows"], meta["truncated"], meta["max_rows"], meta["agg"]) == (3, True, 3, "daily")
    assert meta["hint"] == S.CUT_HINT
    whole = measurements.measurements(spark, root, today=date(2024, 1, 31), agg="daily", tier="full", fmt="csv")
    meta_of_all = measurements.write_answer(whole, str(tmp_path / "b"), "csv")
    assert "hint" not in meta_of_all and meta_of_all["rows"] == whole.rows.count() and meta_of_all["max_rows"] is None
    (document,) = spark.read.text(str(tmp_path / "a" / "meta")).collect()
    assert json.loads(document.value) == meta
    lines = spark.read.text(str(tmp_path / "a" / "data")).collect()
    assert json.loads(lines[0].value)["period_start"] == result.rows.first().period_start.isoformat()


def described_twice(spark):
    """`dimension` and a second description of two of its raw ids, one in the same city."""
    dim = dimension(spark)
    again = dim.where("station_id IN ('site_2', 'site_4')").withColumns(
        {"station_name": F.lit("Second"), "city_name": F.when(F.col("station_id") == "site_2", F.lit("City 9")).otherwise(F.col("city_name"))}
    )
    return dim.unionByName(again)


@pytest.mark.parametrize("cut_up", [False, True])
def test_readings_come_under_each_description_where_that_is_asked_for(spark, root, monkeypatch, cut_up):
    if cut_up:  # ranges by expected counts, of several tasks
        monkeypatch.setattr("hourmark.operators.fact.LEAST_TASK_ROWS", 50)
    data, dim = source(spark, [JAN, FEB]), described_twice(spark)
    for months in ([JAN, FEB], [FEB]):  # from counted keys, then from what was published before
        asked = spark.createDataFrame([(m,) for m in months], "month date")
        made = publish.publish(spark, root, lambda m: readings.timescale_readings(data, m), dim, asked, each_description=True)
    kept = data.where("value IS NOT NULL")
    fact = tree.scan_tree(spark, root)
    wanted = kept.join(dim, kept.station_id == dim.raw_id).select(dim.station_id, "station_name", "city_name", F.col("time").alias("collected_at"), "value")
    assert wanted.count() > kept.count()
    assert rows_of(fact.select(wanted.columns)) == rows_of(wanted)
    listed = rows_of(tree.read_stations(spark, root).select("station_id", "station_name", "city_name", "latitude"))
    assert listed == rows_of(dim.select("station_id", "station_name", "city_name", "latitude"))
    assert {(r.station_id, r.n_rows) for r in tree.read_stations(spark, root).collect()} == {
        (r.station_id, r["count"]) for r in fact.groupBy("station_id").count().collect()
    }
    summary = catalog.coverage_summary(made.manifest).first()
    assert (summary.rows, summary.stations) == (wanted.count(), 9)


def test_two_descriptions_of_a_raw_id_are_refused_unless_asked_for(spark, root):
    none = spark.createDataFrame([(JAN,)], "month date")
    with pytest.raises(DuplicateStations):
        publish.publish(spark, root, lambda _: None, described_twice(spark), none)
    twice = dimension(spark).unionByName(dimension(spark).withColumn("raw_id", F.concat("raw_id", F.lit("_x"))))
    with pytest.raises(DuplicateStations):
        publish.publish(spark, root, lambda _: None, twice, none, each_description=True)
    assert not publish.exists(spark, root)


def test_a_new_tree_is_dealt_without_counting_its_keys(spark, root, monkeypatch):
    def counted(*_):
        raise AssertionError("the keys of the source were counted")

    monkeypatch.setattr("hourmark.plans.publish.key_counts", counted)
    data = source(spark, [JAN, FEB])
    run(spark, root, data, [JAN, FEB])
    run(spark, root, data, [FEB])  # by what was published
    kept = data.where("value IS NOT NULL").select("station_id", F.col("time").alias("collected_at"), "value")
    published = tree.scan_tree(spark, root).select(F.col("station_id"), "collected_at", "value")
    assert rows_of(published) == rows_of(kept.withColumn("station_id", F.regexp_extract("station_id", "^site_[0-9]+", 0)))


def test_keys_of_files_are_made_once_per_file(spark, root):
    data = source(spark, [JAN, FEB])
    run(spark, root, data, [JAN, FEB])
    files = catalog.file_sizes(tree.scan_tree(spark, root), root, "measurements")
    lines = files._jdf.queryExecution().optimizedPlan().toString().splitlines()
    over_rows = lines[max(n for n, line in enumerate(lines) if "Aggregate [" in line) + 1 :]
    assert not any("regexp_extract" in line or "decode" in line for line in over_rows)
    found = files.collect()
    assert sum(r.rows for r in found) == data.where("value IS NOT NULL").count()
    assert all(r.key.startswith(tree.month_key(r.year, r.month)) and r.key.endswith(".parquet") and r.bytes > 0 for r in found)
