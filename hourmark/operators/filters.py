"""Predicates of a measurements or stations request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.runtime import cut

# Longer lists are joined, and written into the plan as so many ranges that hold them.
IN_LIST_MAX = 500
RANGES_MAX = 64


def keep_members(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows whose `column` is one of `values`; no values means no restriction."""
    if not values:
        return df
    if len(values) <= IN_LIST_MAX:
        return df.where(F.col(column).isin(list(values)))
    listed = sorted(set(values))
    step = -(-len(listed) // RANGES_MAX)
    ranges = [(part[0], part[-1]) for part in (listed[k : k + step] for k in range(0, len(listed), step))]
    found = df.sparkSession.createDataFrame([(v,) for v in listed], f"{column} string")
    return df.where(in_ranges(column, ranges)).join(found, column, "left_semi")


def keep_found(df: DataFrame, column: str, found: DataFrame, among: DataFrame) -> DataFrame:
    """Rows whose `column` is one of the distinct values found, in a form that a scan can use: as a list in the
    plan while there are at most IN_LIST_MAX, else as the ranges `among` all values that hold them, and a join."""
    values = [row[0] for row in found.limit(IN_LIST_MAX + 1).collect()]
    if len(values) <= IN_LIST_MAX:
        return df.where(F.col(column).isin(values))
    ranges = [(r.low, r.high) for r in ranges_of(found, among, column).collect()]
    return df.where(in_ranges(column, ranges)).join(found, column, "left_semi")


def ranges_of(found: DataFrame, among: DataFrame, column: str, most: int = RANGES_MAX) -> DataFrame:
    """(low, high): at most so many ranges that hold the values found and, of `among` all values, as few
    others as can be: they end where the most others lie between two found. One row per value takes part."""
    placed = among.select(column).distinct().withColumn("place", F.row_number().over(Window.orderBy(column)))
    hits = placed.join(found.select(column), column, "left_semi")
    hits = cut(hits.withColumn("gap", F.col("place") - F.lag("place").over(Window.orderBy("place")) - 1))
    widest = hits.where("gap > 0").orderBy(F.desc("gap"), "place").limit(most - 1).select("place", F.lit(1).alias("opens"))
    numbered = hits.join(widest, "place", "left").withColumn("range", F.sum("opens").over(Window.orderBy("place")))
    return numbered.groupBy("range").agg(F.min(column).alias("low"), F.max(column).alias("high")).select("low", "high")


def in_ranges(column: str, ranges: Sequence[tuple[str, str]]) -> Column:
    """Whether the column lies in one of some ranges, as a balanced tree of conditions."""
    if not ranges:
        return F.lit(False)
    if len(ranges) == 1:
        return F.col(column).between(*ranges[0])
    middle = len(ranges) // 2
    return in_ranges(column, ranges[:middle]) | in_ranges(column, ranges[middle:])


def same_text(column: str, text: str) -> Column:
    """Equality without regard to case."""
    return F.lower(F.col(column)) == F.lower(F.lit(text))


def name_contains(column: str, text: str) -> Column:
    """Substring without regard to case; `%` and `_` in `text` match as wildcards, `\\` as itself."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    return F.col(column).ilike(pattern)


def all_of(
    *,
    source: str | None = None,
    state: str | None = None,
    city: str | None = None,
    name: str | None = None,
) -> Column:
    """The given restrictions together; those left out hold for every row."""
    condition = F.lit(True)
    if source:
        condition = condition & (F.col("source") == source)
    if state:
        condition = condition & same_text("state_name", state)
    if city:
        condition = condition & same_text("city_name", city)
    if name:
        condition = condition & name_contains("station_name", name)
    return condition


def plausible(low: float = 0, high: float = 1000) -> Column:
    """Analysis-side range check; the published values are not filtered."""
    return F.col("value").between(low, high)
