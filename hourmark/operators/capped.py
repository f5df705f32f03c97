"""Row caps: the first rows of an ordered result, and whether any were cut off."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.runtime import cut

# A top-k brings up to k rows of every task to a single one; longer prefixes are cut where they lie.
TOP_K_MAX = 10_000


@dataclass
class Answer:
    """`rows` in order and capped; `report` has one row: rows, truncated, max_rows.

    Asked for by itself, the report counts the result. `deliver` has it from the pass that makes the rows.
    """

    rows: DataFrame
    report: DataFrame
    meta: dict = field(default_factory=dict)
    seen: Observation | None = None
    cap: int | None = None

    def deliver(self, action: Callable[[DataFrame], Any]) -> dict:
        """Run an action that takes all of `rows`, and return the report of what it ran over."""
        action(self.rows)
        return self.report.first().asDict() if self.seen is None else report_of(self.seen.get["total"], self.cap)


def row_cap(tier_max: int | None, limit: int | None, fmt: str) -> int | None:
    """Rows a caller may get, None for all. JSON is held lower unless nothing caps the caller."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    if tier_max is None:
        cap = limit
    elif limit is None:
        cap = tier_max
    else:
        cap = min(limit, tier_max)
    if fmt == "json" and cap is not None:
        cap = min(cap, S.JSON_MAX_ROWS)
    return cap


def tier_max_rows(tier: str) -> int | None:
    return S.TIER_MAX_ROWS[tier if tier in S.TIER_MAX_ROWS else S.DEFAULT_TIER]


def report_of(total: int, cap: int | None) -> dict:
    return {"rows": total if cap is None else min(total, cap), "truncated": cap is not None and total > cap, "max_rows": cap}


def first_rows(df: DataFrame, order: list[Column], cap: int | None) -> Answer:
    """The first `cap` rows of a listing, and whether any were cut off."""
    return _watched(df, order, cap)


def _watched(df: DataFrame, order: list[Column], cap: int | None) -> Answer:
    """The rows in order, counted where their last stage takes them in: a top-k takes in all of them, and what
    is below a whole sort would be counted again when its ranges are sampled."""
    seen, total = Observation(), F.count(F.lit(1)).alias("total")
    rows = df.orderBy(*order).observe(seen, total) if cap is None else df.observe(seen, total).orderBy(*order).limit(cap)
    return Answer(rows, cap_report(df, cap), seen=seen, cap=cap)


def capped_answer(df: DataFrame, order: list[str], cap: int | None, top_k_max: int = TOP_K_MAX) -> Answer:
    """`capped` with its report, which comes with the rows: a long prefix has counted everything by its
    leading column already."""
    if cap is not None and cap > top_k_max:
        counts = cut(df.groupBy(order[0]).agg(F.count(F.lit(1)).alias("n")))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        return Answer(_prefix(df, order[0], _in_order(df, order), cap, counts), _reports(total, [cap]), cap=cap)
    return _watched(df, _in_order(df, order), cap)


def _in_order(df: DataFrame, order: list[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order + [c for c in df.columns if c not in order]]


def capped(df: DataFrame, order: list[str], cap: int | None, top_k_max: int = TOP_K_MAX) -> DataFrame:
    """The first `cap` rows of `df` by the `order` columns, nulls last, in that order.

    Rows equal in all `order` columns are told apart by the remaining columns, so the cut is the
    same on every run.
    """
    in_order = _in_order(df, order)
    if cap is None:
        return df.orderBy(*in_order)
    if cap <= top_k_max:
        return df.orderBy(*in_order).limit(cap)
    return _prefix(df, order[0], in_order, cap, df.groupBy(order[0]).agg(F.count(F.lit(1)).alias("n")))


def cap_report(df: DataFrame, cap: int | None) -> DataFrame:
    """One row: rows returned under the cap, whether some were cut, and the cap. Needs no sort."""
    return cap_reports(df, [cap]).drop("request")


def cap_reports(df: DataFrame, caps: list[int | None]) -> DataFrame:
    """The report of each of several caps on one result, numbered in `request`; the result is counted once."""
    return _reports(df.agg(F.count(F.lit(1)).alias("total")), caps, "request")


def _reports(total: DataFrame, caps: list[int | None], *number: str) -> DataFrame:
    asked = F.array(*[F.struct(F.lit(k).alias("request"), F.lit(cap).cast("bigint").alias("max_rows")) for k, cap in enumerate(caps)])
    each = total.select("total", F.inline(asked))
    return each.select(
        *number,
        F.least("total", "max_rows").alias("rows"),
        F.coalesce(F.col("total") > F.col("max_rows"), F.lit(False)).alias("truncated"),
        "max_rows",
    )


def _prefix(df: DataFrame, lead: str, in_order: list[Column], n: int, counts: DataFrame) -> DataFrame:
    """The first `n` rows, without bringing them together.

    Counts by the leading column tell which of its values can be in at all. What is left is sorted by
    range once, and the sizes of its parts show in which one the cut falls.
    """
    running = Window.orderBy(F.asc_nulls_last(lead)).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).where(F.col("before") < n)
    wanted = wanted.select(F.col(lead).alias("__lead"))
    left = df.join(wanted, F.col(lead).eqNullSafe(F.col("__lead")), "left_semi")
    parts = cut(left.orderBy(*in_order).withColumn("__part", F.spark_partition_id()))
    before = 0
    for part, size in sorted(parts.groupBy("__part").agg(F.count(F.lit(1))).collect()):  # one row per task
        if before + size > n:
            edge = parts.where(F.col("__part") == part).orderBy(*in_order).limit(n - before)
            parts = parts.where(F.col("__part") < part).unionByName(edge)
            break
        before += size
    return parts.drop("__part").orderBy(*in_order)
