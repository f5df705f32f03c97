"""Places of rows in the order of their group, where one group may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourmark.runtime import cut, small_side

# monotonically_increasing_id numbers the rows of a partition from 0 in its low bits.
ROW_BITS = 33


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`df`, which should be cut already, with `rank` (from 0, gapless in each group) and `members`.

    Rows are dealt in ranges of group and order, sorted in their partitions and numbered there; what
    stands before a partition's rows of a group is a sum over partitions. So no group is gathered,
    however large. Rows that are equal in `order` are told apart by where they lie, which also lets a
    range end between them. Nulls come first, and are a group like any other.
    """
    keys = [*group, *order, "__row"]
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    dealt = cut(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("__at", ROW_BITS), F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))

    # a row for every partition and group that meet: partitions hold few groups, groups follow each other
    met = cut(
        dealt.groupBy(part.alias("__part"), *[F.col(c).alias(f"__{c}") for c in group]).agg(
            F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")
        )
    )
    whole = Window.partitionBy(*[f"__{c}" for c in group])
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("members", F.sum("__n").over(whole))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group], part == F.col("__part"))
    joined = dealt.join(small_side(met), same)
    rank = place - F.col("__first") + F.col("__before")
    return joined.select(*[c for c in df.columns], rank.cast("bigint").alias("rank"), F.col("members").cast("bigint"))
