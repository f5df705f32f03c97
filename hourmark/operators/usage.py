"""Request metering, keys and users."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.functions.time import moment, naive
from hourmark.operators.capped import Answer, first_rows


def usage_daily(log: DataFrame) -> DataFrame:
    """Requests, bytes and last use per key and UTC day of a request log (key_id, ts, bytes)."""
    timed = log.select("key_id", naive(log, "ts").alias("ts"), "bytes")
    return timed.groupBy("key_id", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), F.max("ts").alias("last_used")
    )


def last_used(keys: DataFrame, daily: DataFrame) -> DataFrame:
    """Keys with the time of their latest request."""
    latest = daily.groupBy(F.col("key_id").alias("id")).agg(F.max("last_used").alias("last_used_at"))
    return keys.drop("last_used_at").join(latest, "id", "left")


def merge_usage(daily: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters of both tables added up per key and day."""
    columns = ["key_id", "day", "requests", "bytes"]
    both = daily.select(*columns).unionByName(delta.select(*columns))
    return both.groupBy("key_id", "day").agg(F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"))


def report_days(days: object) -> int:
    """Days a report looks back: 1 to 90, and 7 where the argument does not begin with a number."""
    number = re.match(r"\s*[+-]?\d+", str(days))
    asked = int(number.group()) if number else 0
    return min(max(asked, 1), 90) if asked else 7


def usage_report(
    daily: DataFrame, keys: DataFrame, today: date, days: object = 7, cap: int | None = S.USAGE_REPORT_CAP
) -> Answer:
    """Busiest keys since `days` before `today`, with owner and tier.

    Usage is summed to one row per key before the join, and only the keys kept are looked up.
    """
    since = today - timedelta(days=report_days(days))
    summed = (
        daily.where(F.col("day") >= F.lit(since))
        .groupBy("key_id")
        .agg(F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"), F.max("day").alias("last_day"))
    )
    busiest = first_rows(summed, [F.desc("requests"), F.asc("key_id")], cap)
    wanted = keys.select(F.col("id").alias("key_id"), "owner", "tier").join(busiest.rows.select("key_id"), "key_id", "left_semi")
    rows = (
        busiest.rows.join(wanted, "key_id", "left")
        .select(
            "key_id",
            F.coalesce("owner", F.lit(S.DEMO_OWNER)).alias("owner"),
            F.coalesce("tier", F.lit(S.DEMO_TIER)).alias("tier"),
            "requests",
            "bytes",
            "last_day",
        )
        .orderBy(F.desc("requests"), "key_id")
    )
    return Answer(rows, busiest.report)


def newest_keys(keys: DataFrame, owner: str | None = None, cap: int | None = S.KEYS_LISTING_CAP) -> Answer:
    """Newest keys first: all of one owner's, or the newest of everybody's."""
    order = [F.desc("created_at"), F.asc("id")]
    if owner is not None:
        return first_rows(keys.where(F.col("owner") == owner), order, None)
    return first_rows(keys, order, cap)


def users_with_key(
    users: DataFrame, keys: DataFrame, only_upgrades: bool = False, cap: int | None = S.USERS_LISTING_CAP
) -> Answer:
    """Newest users with the id and tier of their newest key that is not revoked.

    The time of each owner's newest key is found first, an aggregate of fixed width that needs no sort.
    """
    asked = users.where(F.col("wants_upgrade")) if only_upgrades else users
    listed = first_rows(asked, [F.desc("created_at"), F.asc("email")], cap)
    usable = keys.where(F.col("revoked_at").isNull()).join(listed.rows.select(F.col("email").alias("owner")), "owner", "left_semi")
    latest = usable.groupBy(F.col("owner").alias("__owner")).agg(F.max("created_at").alias("__at"))
    is_latest = (F.col("owner") == F.col("__owner")) & F.col("created_at").eqNullSafe(F.col("__at"))
    newest = usable.join(latest, is_latest, "left_semi").groupBy(F.col("owner").alias("email"))
    newest = newest.agg(F.max(F.struct("id", "tier")).alias("k"))
    rows = (
        listed.rows.join(newest, "email", "left")
        .select(*users.columns, F.col("k.id").alias("active_key_id"), F.col("k.tier").alias("tier"))
        .orderBy(F.desc("created_at"), "email")
    )
    return Answer(rows, listed.report)


def active_keys(keys: DataFrame, at: datetime) -> DataFrame:
    """Keys neither revoked nor past their expiry at a time."""
    return keys.where(
        F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= moment(at)))
    )


def merge_profiles(profiles: DataFrame, updates: DataFrame) -> DataFrame:
    """One profile per email: the latest name, affiliation and purpose, the first `created_at`.

    `profiles` (email, name, affiliation, purpose, created_at) come before all `updates`, which
    have `updated_at` and a `seq` for equal times.
    """
    fields = ["name", "affiliation", "purpose"]
    old = profiles.select(
        "email",
        *fields,
        F.col("created_at").alias("updated_at"),
        F.lit(0).alias("age"),
        F.lit(0).cast("bigint").alias("seq"),
    )
    new = updates.select("email", *fields, "updated_at", F.lit(1).alias("age"), F.col("seq").cast("bigint").alias("seq"))
    first = F.coalesce(F.min(F.when(F.col("age") == 0, F.col("updated_at"))), F.min("updated_at"))
    latest = F.max(F.struct("age", "updated_at", "seq", *fields))
    merged = old.unionByName(new).groupBy("email").agg(first.alias("created_at"), latest.alias("latest"))
    return merged.select("email", *[F.col(f"latest.{f}").alias(f) for f in fields], "created_at")


# -- limits -------------------------------------------------------------------


def requests_per_minute(log: DataFrame) -> DataFrame:
    """Requests per key and tumbling minute."""
    timed = log.select("key_id", naive(log, "ts").alias("ts"))
    return (
        timed.groupBy("key_id", F.window("ts", "60 seconds").alias("minute"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("key_id", F.col("minute.start").alias("window_start"), "n")
    )


def over_limit(per_minute: DataFrame, keys: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Minutes in which a key passed its tier's limit; keys without a row count as demo.

    The unlimited tiers have no limit; any other tier that `limits` leaves out has that of the default
    tier. Only minutes above the least limit reach the join with the key table.
    """
    limits = S.TIER_REQUESTS_PER_MINUTE if limits is None else limits
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    most = F.coalesce(F.try_element_at(known, F.col("tier")), F.lit(limits[S.DEFAULT_TIER])).cast("bigint")
    suspects = per_minute.where(F.col("n") > min(limits.values()))
    return (
        suspects.join(keys.select(F.col("id").alias("key_id"), "tier"), "key_id", "left")
        .withColumn("tier", F.coalesce("tier", F.lit(S.DEMO_TIER)))
        .where(~F.col("tier").isin(S.UNLIMITED_TIERS))
        .withColumn("max_requests", most)
        .where(F.col("n") > F.col("max_requests"))
        .select("key_id", "tier", "window_start", "n", "max_requests")
    )
