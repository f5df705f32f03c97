"""Allow and block rules on URLs, matched by a sorted sweep.

A rule is a host and the start of a path; it fits that host and all its subdomains. Hosts are turned
round label by label, so that a rule's domain is a prefix, and a rule becomes an interval of keys:
level, reversed host, path. A URL is looked up once at each level, that is with each of its parent
domains that some rule may name. Intervals of rules are nested or apart, so a sweep over the sorted
keys needs a stack only: where a rule opens, it is on top; where it closes, the rule that encloses it
is on top again. The rule on top where a URL stands is the longest that fits at that level, and the
deepest level wins.

The keys are cut into ranges of about equally many URLs. Each range is swept by itself, starting
with the top of the stack that the ranges before it leave behind, so neither many rules nor a host
that holds most URLs end in one task. Built-in functions only.

Defined cases: a null URL, or one without `://`, has an empty host and path and no rule. Rules with a
null host are ignored, a null path is empty. Of rules with the same host and path, block wins. A URL
without a rule is allowed. Repeated rows each get their result. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.runtime import cut

DEFAULT_VERDICT = "allow"
# Sampled keys per range that the bounds of the ranges are taken from, and ranges at least.
SAMPLED_PER_RANGE = 32
LEAST_RANGES = 8

# Neither byte occurs in UTF-8: the first ends the host part of a key, the second sorts after all text.
PATH_FOLLOWS, AFTER_ALL = b"\xfe", b"\xff"
OPENS, CLOSES, LOOKS = 0, 1, 2


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _key(labels: Column, level: Column, path: Column) -> Column:
    """`labels` are those of the host, reversed; the key holds the first `level` of them."""
    head = F.concat(F.lpad(level.cast("string"), 5, "0"), F.array_join(F.slice(labels, F.lit(1), level), "."))
    return F.concat(head.cast("binary"), F.lit(PATH_FOLLOWS), path.cast("binary"))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """(key, level, rule, verdict, parent): every rule once, and the rule that encloses it."""
    path = F.coalesce("path", F.lit(""))
    named = rules.where(F.col("host").isNotNull()).groupBy(F.col("host"), path.alias("path")).agg(F.max("verdict").alias("verdict"))
    labels = F.reverse(F.split("host", r"\."))
    keyed = named.select(
        "host", "path", "verdict", F.size(labels).alias("level"), F.concat("host", "path").alias("rule"),
        _key(labels, F.size(labels), F.col("path")).alias("key"),
    )
    # the enclosing rule has the same host and the longest proper prefix of the path
    inner = keyed.where(F.length("path") > 0)
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring("path", F.lit(1), n))
    tried = inner.select("key", "host", F.explode(prefixes).alias("path"))
    outer = keyed.select("host", "path", F.struct(F.length("path").alias("length"), "level", "rule", "verdict").alias("outer"))
    parents = tried.join(outer, ["host", "path"]).groupBy("key").agg(F.max("outer").alias("parent"))
    return keyed.join(parents, "key", "left").select(
        "key", "level", F.struct("level", "rule", "verdict").alias("own"),
        F.struct("parent.level", "parent.rule", "parent.verdict").alias("parent"),
    )


def _bounds(keys: DataFrame, n_rows: int, ranges: int) -> list[bytes]:
    """At most ranges - 1 sorted keys that cut `keys` into about equal parts, from a bounded sample."""
    wanted = ranges * SAMPLED_PER_RANGE
    sample = keys if n_rows <= wanted else keys.sample(fraction=wanted / n_rows, seed=7)
    seen = sorted(bytes(r[0]) for r in sample.select("key").limit(2 * wanted).collect())
    return sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []


def _range_of(key: Column, bounds: list[bytes]) -> Column:
    """How many bounds are not above `key`: first among every so manieth bound, then between two."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    pages = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    as_array = lambda values: F.transform(F.split(F.lit(",".join(v.hex() for v in values)), ","), F.unhex)
    firsts = F.transform(F.split(F.lit(",".join(p[0].hex() for p in pages)), ","), lambda x: F.unhex(x))
    inner = F.transform(
        F.split(F.lit(";".join(",".join(v.hex() for v in p) for p in pages)), ";"),
        lambda page: F.transform(F.split(page, ","), lambda x: F.unhex(x)),
    )
    page = F.size(F.filter(firsts, lambda b: b <= key))
    within = F.size(F.filter(F.element_at(inner, F.greatest(page, F.lit(1))), lambda b: b <= key))
    return F.when(page == 0, 0).otherwise((page - 1) * step + within)


def match(urls: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) of `urls` that some rule fits."""
    spark = urls.sparkSession
    keyed = cut(_rule_keys(rules))
    levels = sorted(r[0] for r in keyed.select("level").distinct().collect())  # as many as labels in a host
    if not levels:
        return spark.createDataFrame([], "host string, path string, rule string, verdict string")
    distinct = cut(urls.select("host", "path").where(F.col("host") != "").distinct())
    labels = F.reverse(F.split("host", r"\."))
    fitting = F.filter(F.array(*map(F.lit, levels)), lambda n: n <= F.size(labels))
    probes = distinct.select("host", "path", labels.alias("labels"), F.explode(fitting).alias("level"))
    probes = probes.select("host", "path", _key(F.col("labels"), F.col("level"), F.col("path")).alias("key"))
    ranges = ranges or max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(probes, distinct.count() * len(levels), ranges)

    nothing = F.lit(None)
    top = "struct<level:int,rule:string,verdict:string>"
    opening = keyed.select("key", F.lit(OPENS).alias("kind"), F.col("own").cast(top).alias("top"))
    closing = keyed.select(F.concat("key", F.lit(AFTER_ALL)).alias("key"), F.lit(CLOSES).alias("kind"), F.col("parent").cast(top).alias("top"))
    turns = opening.unionByName(closing).withColumn("range", _range_of(F.col("key"), bounds))
    # what each range hands on: the top after its last turn, carried over ranges without one
    last = turns.groupBy("range").agg(F.max_by("top", F.struct("key", "kind")).alias("top"))
    carried = last.select((F.col("range") + 1).alias("range"), "top")
    every = spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("range"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # one row per range
    start = every.join(carried, "range", "left").select("range", F.last("top", ignorenulls=True).over(order).alias("top"))
    start = start.select(F.lit(b"").alias("key"), F.lit(OPENS).alias("kind"), "top", "range")

    # each key is looked up once, however many hosts share a parent domain and a path
    looks = probes.select("key").distinct().select("key", F.lit(LOOKS).alias("kind"), nothing.cast(top).alias("top"), _range_of(F.col("key"), bounds).alias("range"))
    events = turns.unionByName(start).unionByName(looks)
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("top", F.last("top", ignorenulls=True).over(sweep)).where((F.col("kind") == LOOKS) & F.col("top.level").isNotNull())
    best = probes.join(found.select("key", "top"), "key").groupBy("host", "path").agg(F.max("top").alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.join(match(split, rules), ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict")
    )
