"""Requests: filtered slices and roll-ups, with row caps, and their output formats."""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.functions import time as t
from hourmark.operators import filters
from hourmark.operators.capped import Answer, capped_answer, first_rows, row_cap, tier_max_rows
from hourmark.operators.rollup import RAW_COLUMNS, period_rollup
from hourmark.operators.stations import station_search
from hourmark.sources import tree

FORMATS = ("json", "csv", "parquet")
RAW_ORDER = ["station_id", "parameter_name", "collected_at"]
ROLLUP_ORDER = ["station_id", "parameter_name", "period_start"]


def select_rows(
    fact: DataFrame,
    first: date,
    last: date,
    *,
    station: list[str] | None = None,
    parameter: list[str] | None = None,
    state: str | None = None,
    city: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Readings of days `first` through `last` that meet every restriction given."""
    days = fact.where(t.within(F.col("collected_at"), first, last + timedelta(days=1)))
    days = filters.keep_members(days, "station_id", station)
    days = filters.keep_members(days, "parameter_name", parameter)
    return days.where(filters.all_of(source=source, state=state, city=city))


def answer(
    fact: DataFrame,
    *,
    today: date,
    start: str | date | None = None,
    end: str | date | None = None,
    agg: str = "raw",
    fmt: str = "json",
    limit: int | None = None,
    max_rows: int | None = None,
    **restrictions,
) -> Answer:
    """A request over any fact-shaped DataFrame. `max_rows` is the caller's tier maximum."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    first, last = t.day_window(start, end, today)
    rows = select_rows(fact, first, last, **restrictions)
    if agg == "raw":
        rows, order = rows.select(*RAW_COLUMNS), RAW_ORDER
    else:
        rows, order = period_rollup(rows, agg), ROLLUP_ORDER
    cap = row_cap(max_rows, limit, fmt)
    meta = {
        "start": first.isoformat(),
        "end": last.isoformat(),
        "agg": agg,
        "filters": {k: restrictions.get(k) for k in ("station", "parameter", "state", "city", "source")},
        "timezone": S.ANSWER_TIMEZONE,
    }
    found = capped_answer(rows, order, cap)
    found.meta = meta
    return found


def measurements(spark: SparkSession, root: str, *, today: date, tier: str = "full", **request) -> Answer:
    """A request over the published tree; only the months it covers are listed and read."""
    first, last = t.day_window(request.get("start"), request.get("end"), today)
    fact = tree.scan_months(spark, root, first, last)
    named = {k: request[k] for k in ("state", "city", "source") if request.get(k)}
    if named:
        # Files are sorted by station: find the stations that had such a name in these months, so that
        # the scan can skip the others. The names themselves are still checked on the readings.
        series = tree.window_series(spark, root, first, last)
        fact = filters.keep_found(fact, "station_id", tree.matching_stations(series, filters.all_of(**named)), series)
    return answer(fact, today=today, max_rows=tier_max_rows(tier), **request)


def stations(
    spark: SparkSession,
    root: str,
    *,
    source: str | None = None,
    state: str | None = None,
    city: str | None = None,
    q: str | None = None,
    cap: int | None = S.STATIONS_CAP,
) -> Answer:
    condition = filters.all_of(source=source, state=state, city=city, name=q)
    return station_search(tree.read_stations(spark, root), condition, cap)


def list_parameters(parameters: DataFrame, cap: int | None = S.PARAMETERS_CAP) -> Answer:
    return first_rows(parameters, [F.desc("n_rows"), F.asc("parameter_name")], cap)


def parameters(spark: SparkSession, root: str, cap: int | None = S.PARAMETERS_CAP) -> Answer:
    return list_parameters(tree.read_parameters(spark, root), cap)


# -- output -------------------------------------------------------------------


def with_iso_times(df: DataFrame) -> DataFrame:
    """Times as the text JSON carries."""
    kinds = dict(df.dtypes)
    return df.select(*[t.iso_text(F.col(c)).alias(c) if k.startswith("timestamp") else c for c, k in kinds.items()])


def write_answer(result: Answer, path: str, fmt: str) -> dict:
    """Write an answer under `path`: `data` in the format asked for and, for JSON, `meta` beside it.

    JSON rows are written one to a line by the tasks that hold them, so that an uncapped answer is
    never gathered into one document. Returns the meta data, whose counts come from the same pass as
    the rows, with a hint where some were cut.
    """
    spark = result.rows.sparkSession
    if fmt == "json":
        write = lambda rows: with_iso_times(rows).write.mode("overwrite").json(f"{path}/data", ignoreNullFields=False)
    elif fmt == "csv":
        write = lambda rows: csv_texts(rows).write.mode("overwrite").csv(f"{path}/data", header=True, escape='"')
    elif fmt == "parquet":
        write = lambda rows: rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/data")
    else:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    meta = {**result.meta, **result.deliver(write)}
    if meta["truncated"]:
        meta["hint"] = S.CUT_HINT
    if fmt == "json":
        document = spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string")
        document.coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def csv_texts(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("string").alias(c) if k.startswith("timestamp") else c for c, k in rows.dtypes])
