"""One query per operator of the inventory, each a function of (spark, test directory)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import text as x
from hourmark.functions import time as t
from hourmark.operators import analysis, capped, fact, filters, rollup, series, stations, usage
from hourmark.plans import catalog, measurements, publish
from hourmark.runtime import cut, new_path
from hourmark.sources import readings, registry, tree
from hourmark.streaming import jobs
from workload import standins as s
from workload import trees
from workload.standins import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: _days_as_text(build(Inputs.of(spark, sf_dir)))
    return build


def _days_as_text(df: DataFrame) -> DataFrame:
    """Days as YYYY-MM-DD, which every reader of the results shows alike."""
    days = {c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"}
    return df.withColumns(days) if days else df


def _numbers_as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be missing as text, for the same reason."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def r6(column: str | Column) -> Column:
    """Averages agree between engines up to the order of summation."""
    return F.round(column, 6)


def _off_ties(column: str) -> Column:
    """The same where means of short decimals would lie halfway between two results."""
    return F.round(F.col(column) + F.lit(1.37e-7), 6)


def _mean(df: DataFrame, name: str = "mean") -> DataFrame:
    return df.withColumn(name, r6(name))


def _rolled(df: DataFrame) -> DataFrame:
    return df.select("station_id", "parameter_name", "unit", "period_start", r6("mean").alias("mean"), "min", "max", "n")


def _listed(stations_df: DataFrame) -> DataFrame:
    """Lists as text, for comparison by value."""
    return stations_df.withColumn("parameters", F.array_join("parameters", ","))


# -- scans, sources and sinks -------------------------------------------------


@query
def src_readings_month(i: Inputs) -> DataFrame:
    return readings.timescale_readings(i.readings(), [date(2024, 1, 1)])


def _zoned(i: Inputs, column: str) -> DataFrame:
    """Events as instants, read in a session whose clock changes twice a year, half of them moved to
    the hours around both changes."""
    session = i.spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
    events = session.read.parquet(f"{i.sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    n = F.col("event_id")
    change = F.when(n % 4 == 1, F.lit("2023-11-05 03:00:00+00:00")).otherwise(F.lit("2024-03-10 04:00:00+00:00")).cast("timestamp")
    own = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")).cast("timestamp")
    moved = F.timestamp_add("MINUTE", (n % 480).cast("int"), change)
    return events.select("event_id", F.when(n % 2 == 1, moved).otherwise(own).alias(column))


@query
def src_readings_zone(i: Inputs) -> DataFrame:
    """One month of instants, in a session that is not in UTC."""
    events = _zoned(i, "time")
    raw = events.select("time", F.col("event_id").cast("string").alias("station_id"), F.lit("p").alias("parameter"), F.lit(1.0).alias("value"), F.lit("u").alias("unit"))
    return readings.timescale_readings(raw, [date(2023, 11, 1), date(2024, 3, 1)])


@query
def ts_render_zone(i: Inputs) -> DataFrame:
    return _zoned(i, "time").select("event_id", t.wall_clock(F.col("time")).alias("collected_at"))


@query
def src_dashboard_month(i: Inputs) -> DataFrame:
    return readings.dashboard_readings(i.dashboard(), [date(2024, 1, 1)])


@query
def src_registry_clean(i: Inputs) -> DataFrame:
    rows = registry.load_registry(i.spark, trees.registry_files(i))
    return rows.select(
        F.col("seq.file").alias("file_rank"), "full_name", "norm", "state", "city", "latitude", "longitude"
    )


@query
def src_portal_clean(i: Inputs) -> DataFrame:
    return registry.load_portal(i.spark, trees.portal_file(i))


@query
def src_constants(i: Inputs) -> DataFrame:
    """Readings of the stations described by constants."""
    counts = i.m().groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    fixed = i.view("fixed")
    return fixed.join(counts, "station_id", "left").select(
        *registry.fixed_stations(i.spark).columns, F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def scan_tree(i: Inputs) -> DataFrame:
    rows = tree.scan_tree(i.spark, trees.hist(i))
    return rows.groupBy("year", "month", "source", "station_id", "station_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("collected_at").alias("last")
    )


@query
def scan_pruned(i: Inputs) -> DataFrame:
    return tree.scan_days(i.spark, trees.hist(i), *s.HIST_WINDOW)


@query
def scan_published(i: Inputs) -> DataFrame:
    """Whole months of the window, found through the manifest."""
    return tree.scan_months(i.spark, trees.hist(i), *s.HIST_WINDOW)


@query
def scan_empty(i: Inputs) -> DataFrame:
    """A request whose window begins long before the first published month."""
    result = measurements.measurements(
        i.spark, trees.hist(i), today=s.HIST_TODAY, start="1985-06-10", end="1992-03-15", agg="monthly", fmt="csv"
    )
    return _rolled(result.rows)


def _months_of_1996(i: Inputs, first: int, last: int) -> DataFrame:
    keys = [r.key for r in tree.month_keys(i.spark, 1996, first, last).collect()]
    return tree.scan_keys(i.spark, trees.hist(i), keys)


@query
def scan_file_list(i: Inputs) -> DataFrame:
    return _months_of_1996(i, 3, 6)


@query
def sink_months(i: Inputs) -> DataFrame:
    return tree.scan_tree(i.spark, trees.hist(i))


@query
def sink_stale_months(i: Inputs) -> DataFrame:
    """Months of the corrected year that are in the tree but no longer have readings."""
    asked = t.calendar(i.spark, s.HIST_TODAY, months=trees.CORRECTED_MONTHS)
    fresh = readings.timescale_readings(i.corrected(), trees.CORRECTED_MONTHS)
    produced = fresh.select(t.month_of(F.col("collected_at")).alias("month")).distinct()
    published = tree.manifest_months(tree.read_manifest(i.spark, trees.hist(i)))
    existing = published.select(F.make_date("year", "month", F.lit(1)).alias("month"))
    return publish.stale_months(asked, produced, existing)


@query
def manifest_months(i: Inputs) -> DataFrame:
    root = trees.hist(i)
    return catalog.month_sizes(catalog.file_sizes(tree.scan_tree(i.spark, root), root, "measurements")).select(
        "year", "month", "rows", "key", (F.col("bytes") > 0).alias("has_bytes")
    )


@query
def manifest_read(i: Inputs) -> DataFrame:
    return tree.manifest_months(tree.read_manifest(i.spark, trees.hist(i))).select("year", "month", "rows", "key")


@query
def sink_formats(i: Inputs) -> DataFrame:
    """A daily roll-up written in each format and read back."""
    shape = "station_id string, parameter_name string, unit string, period_start timestamp_ntz, mean double, min double, max double, n bigint"
    parts = []
    for fmt in measurements.FORMATS:
        result = measurements.answer(
            i.m(), today=s.TODAY, start=s.MONTH[0], end=s.MONTH[1], agg="daily", fmt=fmt, parameter=["PM2.5"]
        )
        path = new_path(i.spark, f"answer-{fmt}")
        measurements.write_answer(result, path, fmt)
        reader = i.spark.read.schema(shape)
        back = reader.csv(f"{path}/data", header=True, escape='"') if fmt == "csv" else reader.format(fmt).load(f"{path}/data")
        parts.append(_rolled(back).withColumn("format", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def files_catalog(i: Inputs) -> DataFrame:
    listed = catalog.files_catalog(tree.read_manifest(i.spark, trees.hist(i)))
    return _numbers_as_text(listed.drop("bytes"), "year", "month", "rows")


@query
def files_visible(i: Inputs) -> DataFrame:
    listed = catalog.files_catalog(tree.read_manifest(i.spark, trees.hist(i)))
    return catalog.visible_files(listed, [1996]).select("key", "kind")


@query
def scan_visible_years(i: Inputs) -> DataFrame:
    """What a caller limited to one year may scan."""
    rows = tree.visible_years(tree.scan_tree(i.spark, trees.hist(i)), [1996])
    return rows.groupBy("year", "month", "station_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# -- projections and filters --------------------------------------------------


@query
def canonical_fact(i: Inputs) -> DataFrame:
    return fact.canonical_fact(readings.timescale_readings(i.readings()), i.station_dim())


@query
def canonical_dashboard(i: Inputs) -> DataFrame:
    """The dashboard shape keeps the spaces of its parameter names."""
    return fact.canonical_fact(readings.dashboard_readings(i.dashboard()), i.station_dim())


def _slice(i: Inputs, **restrictions) -> DataFrame:
    return measurements.select_rows(i.m(), *s.MONTH, **restrictions).select(*rollup.RAW_COLUMNS)


@query
def flt_date_window(i: Inputs) -> DataFrame:
    return _slice(i)


@query
def flt_in_lists(i: Inputs) -> DataFrame:
    return _slice(i, station=s.STATIONS, parameter=s.PARAMETERS)


@query
def flt_city_ci(i: Inputs) -> DataFrame:
    return _slice(i, city="nation_3")


@query
def flt_name_ilike(i: Inputs) -> DataFrame:
    named = i.m().where(filters.name_contains("station_name", s.NAME_PART))
    return named.select("station_name", *rollup.RAW_COLUMNS)


@query
def flt_combined(i: Inputs) -> DataFrame:
    return _slice(i, state="asia", source="cpcb_caaqm", parameter=s.PARAMETERS)


def _stations(i: Inputs) -> DataFrame:
    return series.stations_table(series.series_summary(i.m()), i.station_dim())


@query
def stations_search(i: Inputs) -> DataFrame:
    condition = filters.all_of(state="asia", source="cpcb_caaqm", name=s.NAME_PART)
    return _listed(stations.station_search(_stations(i), condition).rows)


@query
def stations_search_report(i: Inputs) -> DataFrame:
    """What a station request is told about rows cut off."""
    found = stations.station_search(_stations(i), filters.all_of(state="asia"), cap=2)
    return found.report


@query
def parameters_list(i: Inputs) -> DataFrame:
    return measurements.list_parameters(series.parameters_table(series.series_summary(i.m()))).rows


# -- scalar expressions -------------------------------------------------------


@query
def unit_harmonise(i: Inputs) -> DataFrame:
    return i.view("raw").groupBy("unit", x.harmonise_unit(F.col("unit")).alias("harmonised")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _raw_stations(i: Inputs) -> DataFrame:
    return stations.raw_stations(i.view("raw"), i.view("raw_stations"))


@query
def station_public_id(i: Inputs) -> DataFrame:
    return _raw_stations(i).select("raw_id", "station_id", "station_name", "name_derived")


@query
def name_norm_key(i: Inputs) -> DataFrame:
    return i.view("reg").select("full_name", x.name_key(F.col("full_name")).alias("norm"))


@query
def ts_render_utc(i: Inputs) -> DataFrame:
    instants = i.table("events").select("event_id", F.col("ts").cast("timestamp").alias("time"))
    return instants.select("event_id", t.wall_clock(F.col("time")).alias("collected_at"))


@query
def month_calendar(i: Inputs) -> DataFrame:
    """The months each way of choosing them gives, and which of them the tree has."""
    published = tree.manifest_months(tree.read_manifest(i.spark, trees.hist(i)))
    choices = {
        "full": trees.hist_months(i),
        "since": t.calendar(i.spark, s.HIST_TODAY, since="2001-06"),
        "recent": t.calendar(i.spark, s.HIST_TODAY, recent=3),
        "listed": t.calendar(i.spark, s.HIST_TODAY, months=["1999-02", "1998-01", "1999-02"]),
    }
    parts = [catalog.missing_months(c, published).withColumn("mode", F.lit(mode)) for mode, c in choices.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# -- stations -----------------------------------------------------------------


@query
def station_raw(i: Inputs) -> DataFrame:
    return _raw_stations(i)


@query
def station_raw_dashboard(i: Inputs) -> DataFrame:
    return stations.raw_stations_dashboard(i.dashboard())


@query
def registry_first(i: Inputs) -> DataFrame:
    rows = stations.first_listed(registry.load_registry(i.spark, trees.registry_files(i)))
    return rows.select(
        "full_name", F.col("seq.file").alias("file_rank"), "norm", "state", "city", "latitude", "longitude"
    )


def _resolved(i: Inputs, raw: DataFrame | None = None) -> DataFrame:
    raw = _raw_stations(i) if raw is None else raw
    return stations.resolve_stations(raw, i.view("fixed"), i.portal(), i.registry())


@query
def station_resolve(i: Inputs) -> DataFrame:
    return _resolved(i)


@query
def station_resolve_crowded(i: Inputs) -> DataFrame:
    """The same with a registry that lists every place twice more, at places that are not finite too."""
    reg = i.registry()
    again = reg.withColumns({"seq": F.col("seq") + 1_000_000_000, "latitude": F.col("latitude") + 3.0})
    broken = reg.withColumns({"seq": F.col("seq") + 2_000_000_000, "longitude": F.lit(float("nan"))})
    return stations.resolve_stations(_raw_stations(i), i.view("fixed"), i.portal(), reg.unionByName(again).unionByName(broken))


@query
def station_moved_audit(i: Inputs) -> DataFrame:
    raw = cut(_raw_stations(i))
    moved = stations.moved_stations(raw, _resolved(i, raw))
    return moved.withColumn("km", r6("km"))


@query
def station_quality(i: Inputs) -> DataFrame:
    return stations.station_quality(_resolved(i))


@query
def station_duplicates(i: Inputs) -> DataFrame:
    """Public ids of the source's stations and of the same stations under their bare ids."""
    dim = i.station_dim()
    bare = dim.withColumn("raw_id", F.col("station_id"))
    return stations.duplicate_stations(dim.unionByName(bare).distinct())


@query
def stations_table(i: Inputs) -> DataFrame:
    return _listed(series.in_listing_order(series.stations_table(series.series_summary(i.m()), _resolved(i))))


@query
def station_means_geo(i: Inputs) -> DataFrame:
    return _mean(_placed_means(i))


def _placed_means(i: Inputs) -> DataFrame:
    return analysis.with_place(analysis.station_means(_pm(i), min_readings=5), _stations(i))


# -- aggregations -------------------------------------------------------------


@query
def rollup_hourly(i: Inputs) -> DataFrame:
    return _rolled(rollup.period_rollup(i.m(), "hourly"))


@query
def rollup_daily(i: Inputs) -> DataFrame:
    return _rolled(rollup.period_rollup(i.m(), "daily"))


@query
def rollup_monthly(i: Inputs) -> DataFrame:
    return _rolled(rollup.period_rollup(tree.scan_tree(i.spark, trees.hist(i)), "monthly"))


@query
def station_param_stats(i: Inputs) -> DataFrame:
    return series.station_parameter_stats(series.series_summary(i.m()))


@query
def station_stats(i: Inputs) -> DataFrame:
    return _listed(series.station_stats(series.station_parameter_stats(series.series_summary(i.m()))))


@query
def parameters_table(i: Inputs) -> DataFrame:
    return series.by_size(series.parameters_table(series.series_summary(i.m())))


@query
def month_bounds(i: Inputs) -> DataFrame:
    return readings.month_bounds(i.hist_readings(), "time")


@query
def coverage_by_source(i: Inputs) -> DataFrame:
    return analysis.coverage_by_source(i.m())


def _pm(i: Inputs) -> DataFrame:
    return analysis.of_parameter(i.m(), "PM2.5", 0, 100)


@query
def city_daily_mean(i: Inputs) -> DataFrame:
    return _mean(analysis.city_daily_mean(_pm(i), s.CITIES))


@query
def city_rolling7(i: Inputs) -> DataFrame:
    return _mean(_mean(analysis.city_rolling_mean(analysis.city_daily_mean(_pm(i), s.CITIES))), "rolling")


@query
def diurnal_cycle(i: Inputs) -> DataFrame:
    return analysis.diurnal_cycle(_pm(i), s.CITIES).withColumn("mean", _off_ties("mean"))


@query
def pivot_hour_city(i: Inputs) -> DataFrame:
    wide = analysis.hour_by_city(analysis.diurnal_cycle(_pm(i), s.CITIES), s.CITIES)
    return wide.select("hr", *[_off_ties(c).alias(c) for c in s.CITIES])


@query
def station_means(i: Inputs) -> DataFrame:
    return _mean(analysis.station_means(_pm(i), min_readings=5))


@query
def rank_extremes(i: Inputs) -> DataFrame:
    return analysis.extremes(_placed_means(i))


@query
def city_month_mean(i: Inputs) -> DataFrame:
    year = _months_of_1996(i, 1, 12).where(F.col("parameter_name") == s.HIST_PARAMETER)
    return analysis.city_month_mean(year)


@query
def station_day_mean(i: Inputs) -> DataFrame:
    quarter = _months_of_1996(i, 10, 12).where(F.col("parameter_name") == s.HIST_PARAMETER)
    return _mean(analysis.station_day_mean(quarter))


@query
def station_means_month(i: Inputs) -> DataFrame:
    """Station means over one month of one parameter."""
    march = tree.scan_keys(i.spark, trees.hist(i), [tree.month_key(1996, 3)])
    return _mean(analysis.station_means(analysis.of_parameter(march, s.HIST_PARAMETER, 0, 100), min_readings=2))


@query
def station_month_mean(i: Inputs) -> DataFrame:
    march = tree.scan_keys(i.spark, trees.hist(i), [tree.month_key(1996, 3)])
    return _mean(analysis.station_mean(march.where(F.col("parameter_name") == s.HIST_PARAMETER)))


@query
def network_mean_by_time(i: Inputs) -> DataFrame:
    rows = tree.scan_tree(i.spark, trees.hist(i)).where(F.col("parameter_name") == s.HIST_PARAMETER)
    return _mean(analysis.network_mean_by_time(rows))


@query
def mean_of_means(i: Inputs) -> DataFrame:
    daily = rollup.period_rollup(i.m().where(F.col("parameter_name") == "PM2.5"), "daily")
    return _mean(rollup.mean_of_means(daily))


@query
def pivot_time_station(i: Inputs) -> DataFrame:
    rows = tree.scan_tree(i.spark, trees.hist(i)).where(F.col("parameter_name") == s.HIST_PARAMETER)
    wide = analysis.time_by_station(rows, ["site_1", "site_3", "site_7"])
    return wide.select("collected_at", *[r6(c).alias(c) for c in wide.columns[1:]])


@query
def pivot_time_city(i: Inputs) -> DataFrame:
    """Every station of a city as a column, turned back into rows to be compared."""
    rows = tree.scan_tree(i.spark, trees.hist(i)).where(F.col("parameter_name") == s.HIST_PARAMETER)
    of_city = analysis.city_stations(tree.read_stations(i.spark, trees.hist(i)), "nation_3")
    by_time = analysis.means_by_time(rows, of_city)
    return _mean(by_time.select("collected_at", F.explode("means").alias("station_id", "mean")))


@query
def manifest_by_year(i: Inputs) -> DataFrame:
    """The megabytes depend on the files written, so they are compared with the files' own sizes."""
    months = tree.manifest_months(tree.read_manifest(i.spark, trees.hist(i)))
    files = catalog.file_sizes(tree.scan_tree(i.spark, trees.hist(i)), trees.hist(i), "measurements")
    own = files.groupBy("year").agg(F.bround(F.sum("bytes") / F.lit(1e6), 0).alias("own_mb"))
    return catalog.size_by_year(months).join(own, "year").select("year", "rows", (F.col("mb") == F.col("own_mb")).alias("mb_adds_up"))


@query
def manifest_across_years(i: Inputs) -> DataFrame:
    """Years as columns. The megabytes depend on the files written, so only the rows are compared."""
    months = tree.manifest_months(tree.read_manifest(i.spark, trees.hist(i)))
    wide = catalog.size_across_years(months, list(range(1995, 2002))).where(F.col("measure") == "rows")
    return wide.withColumnsRenamed({str(y): f"y{y}" for y in range(1995, 2002)})


@query
def coverage_summary(i: Inputs) -> DataFrame:
    return catalog.coverage_summary(tree.read_manifest(i.spark, trees.hist(i))).drop("bytes")


# -- sort, limit, sample ------------------------------------------------------


@query
def raw_slice(i: Inputs) -> DataFrame:
    return measurements.answer(i.m(), today=s.TODAY, start=s.MONTH[0], end=s.MONTH[1], parameter=["PM2.5"]).rows


@query
def capped_slice(i: Inputs) -> DataFrame:
    return measurements.answer(i.m(), today=s.TODAY, agg="raw", fmt="csv", limit=50, max_rows=1000).rows


@query
def capped_slice_counted(i: Inputs) -> DataFrame:
    """A prefix cut where it lies instead of a top-k."""
    rows = i.m().select(*rollup.RAW_COLUMNS)
    return capped.capped(rows, measurements.RAW_ORDER, 1234, top_k_max=0)


CAP_CASES = [(None, None, "json"), (None, 50, "csv"), (1000, 50, "csv"), (1000, None, "json"), (100_000_000, None, "csv")]


@query
def capped_slice_flag(i: Inputs) -> DataFrame:
    rows = measurements.select_rows(i.m(), date(2024, 1, 1), s.TODAY)
    daily = rollup.period_rollup(rows, "daily")
    return _numbers_as_text(capped.cap_reports(daily, [capped.row_cap(*case) for case in CAP_CASES]), "max_rows")


@query
def measurements_tree(i: Inputs) -> DataFrame:
    """A request over the published tree: months pruned, filtered, rolled up, in order."""
    result = measurements.measurements(
        i.spark, trees.hist(i), today=s.HIST_TODAY, start="1996-03-10", end="1996-06-20", agg="daily", fmt="csv", city="nation_3"
    )
    return _rolled(result.rows)


@query
def keys_listing(i: Inputs) -> DataFrame:
    everybody = usage.newest_keys(i.view("api_keys")).rows.withColumn("asked", F.lit("all"))
    owned = usage.newest_keys(i.view("api_keys"), owner="7").rows.withColumn("asked", F.lit("owner"))
    return everybody.unionByName(owned)


@query
def station_sample(i: Inputs) -> DataFrame:
    return _listed(analysis.station_sample(_stations(i)))


# -- incremental --------------------------------------------------------------


@query
def incremental_republish(i: Inputs) -> DataFrame:
    rows = tree.scan_tree(i.spark, trees.corrected(i))
    return rows.groupBy("year", "month", "station_id", "station_name", "parameter_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )


@query
def dims_only(i: Inputs) -> DataFrame:
    return _listed(tree.read_stations(i.spark, trees.corrected(i)))


@query
def published_parameters(i: Inputs) -> DataFrame:
    return tree.read_parameters(i.spark, trees.corrected(i))


# -- streaming ----------------------------------------------------------------


@query
def stream_publish(i: Inputs) -> DataFrame:
    return tree.scan_tree(i.spark, trees.streamed(i))


@query
def stream_usage(i: Inputs) -> DataFrame:
    return jobs.metered_usage(i.spark, trees.metered_usage(i))


@query
def stream_usage_late(i: Inputs) -> DataFrame:
    """Several files whose requests come weeks late: no request is lost."""
    return jobs.metered_usage(i.spark, trees.late_usage(i))


@query
def limit_breaches_real(i: Inputs) -> DataFrame:
    """The limit table itself, with a tier it does not list, one without limit, and unknown keys."""
    return usage.over_limit(usage.requests_per_minute(i.view("busy_log")), i.view("busy_keys"))


@query
def stream_breaches(i: Inputs) -> DataFrame:
    return jobs.metered_breaches(i.spark, trees.metered_minutes(i), i.view("api_keys"), s.LIMITS)


@query
def limit_breaches(i: Inputs) -> DataFrame:
    return usage.over_limit(usage.requests_per_minute(i.view("api_log")), i.view("api_keys"), s.LIMITS)


# -- usage, keys, users -------------------------------------------------------


@query
def usage_daily(i: Inputs) -> DataFrame:
    return usage.usage_daily(i.view("api_log"))


@query
def usage_report(i: Inputs) -> DataFrame:
    daily = usage.usage_daily(i.view("api_log"))
    return usage.usage_report(daily, i.view("api_keys"), s.TODAY, days=30).rows


@query
def usage_merge(i: Inputs) -> DataFrame:
    """The counters of the log so far and those of a second delivery of the busy types."""
    daily = usage.usage_daily(i.view("api_log"))
    again = usage.usage_daily(i.view("api_log").where(F.col("bytes") >= 5000))
    return usage.merge_usage(daily, again)


@query
def keys_last_used(i: Inputs) -> DataFrame:
    used = usage.last_used(i.view("api_keys"), usage.usage_daily(i.view("api_log")))
    return used.select("id", "owner", "tier", "last_used_at")


@query
def users_latest_key(i: Inputs) -> DataFrame:
    return usage.users_with_key(i.view("users"), i.view("api_keys")).rows


@query
def profile_merge(i: Inputs) -> DataFrame:
    return usage.merge_profiles(i.view("users").drop("wants_upgrade"), i.view("sign_ups"))


@query
def keys_active(i: Inputs) -> DataFrame:
    return usage.active_keys(i.view("api_keys"), datetime(1998, 6, 1))
