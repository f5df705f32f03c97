"""Wall-clock times, periods and months.

Reading times are `timestamp_ntz`. No expression here depends on the session time zone: instants are
turned into naive UTC times by their number of microseconds, and compared with instants.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark import schema as S

GRAINS = ("hourly", "daily", "monthly")
ISO_DAY_OR_TIME = r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2})?"


def wall_clock(instant: Column) -> Column:
    """The naive UTC rendering of an instant, through no zone: some wall clock times come twice."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def naive(df: DataFrame, column: str) -> Column:
    """The column as a naive time, whichever of the two kinds it has."""
    return wall_clock(F.col(column)) if zoned(df, column) else F.col(column)


def zoned(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] == "timestamp"


def period_start(at: Column, grain: str) -> Column:
    """Start of the hour, day or month that `at` falls in."""
    day = at.cast("date")
    if grain == "hourly":
        return F.timestamp_add("HOUR", F.hour(at), day.cast("timestamp_ntz"))
    if grain == "daily":
        return day.cast("timestamp_ntz")
    if grain == "monthly":
        return F.trunc(day, "MM").cast("timestamp_ntz")
    raise ValueError(f"grain must be one of {', '.join(GRAINS)}")


def month_of(at: Column) -> Column:
    return F.trunc(at.cast("date"), "MM")


def iso_text(at: Column) -> Column:
    """ISO text with microseconds only where there are any."""
    return F.when(
        F.date_format(at, "SSSSSS") == "000000", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def moment(at: date | datetime) -> Column:
    """A `timestamp_ntz` literal; a date stands for its midnight."""
    return F.lit(str(at)).cast("timestamp_ntz")


def within(at: Column, first: date, after: date, is_zoned: bool = False) -> Column:
    """`first` 00:00 <= at < `after` 00:00 in UTC, as literals of the column's kind, which a scan can use."""
    edge = (lambda day: F.lit(f"{day} 00:00:00+00:00").cast("timestamp")) if is_zoned else moment
    return (at >= edge(first)) & (at < edge(after))


# -- calendar arguments -------------------------------------------------------


def parse_day(text: str | date | None) -> date | None:
    """A date, or the date of an ISO day or of an ISO day and time without a zone."""
    if text is None:
        return None
    if isinstance(text, datetime):
        return text.date()
    if isinstance(text, date):
        return text
    if not re.fullmatch(ISO_DAY_OR_TIME, text):
        raise ValueError(f"not a day: {text!r}")
    return datetime.fromisoformat(text).date()


def parse_month(text: str | date) -> date:
    if isinstance(text, date):
        return text.replace(day=1)
    return datetime.strptime(text, "%Y-%m").date()


def day_window(start: str | date | None, end: str | date | None, today: date) -> tuple[date, date]:
    """First and last day of a request, both included."""
    last = parse_day(end) or today
    first = parse_day(start) or last - timedelta(days=S.DEFAULT_WINDOW_DAYS)
    if first > last:
        raise ValueError("start must be on or before end")
    return first, last


def next_month(month: date, steps: int = 1) -> date:
    index = month.year * 12 + month.month - 1 + steps
    return date(index // 12, index % 12 + 1, 1)


def month_runs(months: list[date]) -> list[tuple[date, date]]:
    """Half-open day ranges that cover the given months, neighbouring months joined."""
    runs: list[tuple[date, date]] = []
    for month in sorted(set(months)):
        if runs and runs[-1][1] == month:
            runs[-1] = (runs[-1][0], next_month(month))
        else:
            runs.append((month, next_month(month)))
    return runs


def in_months(at: Column, months: list[date], is_zoned: bool = False) -> Column:
    condition = F.lit(False)
    for first, after in month_runs(months):
        condition = condition | within(at, first, after, is_zoned)
    return condition


def month_series(lo: Column, hi: Column) -> Column:
    """Array of month starts from `lo` through `hi`; empty when `lo` is later."""
    steps = F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))
    return F.when(lo <= hi, steps).otherwise(F.array().cast("array<date>"))


def calendar(
    spark: SparkSession,
    today: date,
    *,
    months: list[str | date] | None = None,
    since: str | date | None = None,
    recent: int | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """The months of a run, one `month` date per row.

    `months` lists them, `since` runs to this month, `recent` counts back from this month, and
    `bounds` (one row `lo`, `hi`, nulls for an empty source) covers a whole source.
    """
    this_month = F.lit(today.replace(day=1))
    if months is not None:
        listed = [(m,) for m in sorted({parse_month(m) for m in months})]
        return spark.createDataFrame(listed, "month date")
    if bounds is not None:
        span = bounds.where(F.col("lo").isNotNull()).select(
            month_series(F.col("lo"), F.greatest(F.col("hi"), this_month)).alias("months")
        )
        return span.select(F.explode("months").alias("month"))
    first = (
        F.lit(parse_month(since))
        if since is not None
        else F.lit(next_month(today.replace(day=1), 1 - max(1, int(recent if recent is not None else 2))))
    )
    return spark.range(1).select(F.explode(month_series(first, this_month)).alias("month"))
