"""Sharding by jump consistent hashing.

A key walks along a sequence of shard numbers that depends on the key alone, and stays on the last one
below the number of shards. One shard more is met by one key in so many, and only there does a key
move. There is no table of the ring. Law: `key`, that is, the key and the number of shards decide,
so rows of one key share a shard, and equal texts only where their keys say so.

The walk is an `aggregate` over a few steps on the JVM, its 64-bit products taken in halves so that
none overflows; the few keys that need more steps take them in a second one, so it is exact for any
number of shards. Places inside a shard come from ranges of the order, as one shard holds far more
than a task should. Built-in functions only.

Defined cases: a whole-number key is used as it is, a null one as 0; other keys by their 64-bit
digest. A null text has no bytes: size 8 (what a row counts besides), checksum 0. Rows with equal
keys, repeated ones included, each get a slot. An empty table gives no rows. Extra columns, whatever their names, are
carried by `place` and `moved` and not read by `layout`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourmark.llm.ranks import ranked
from hourmark.llm.words import let
from hourmark.runtime import cut

# Fixed values of the published function: its multiplier, and the bits of the key that make a fraction.
MULTIPLIER = 2862933555777941757
FRACTION_BITS = 31
# Parameters: shards of the registered query, bytes a row counts besides its text, steps that nearly
# every key is done in.
SHARDS = 24
ROW_BYTES = 8
FIRST_STEPS = 16

WORD, HALF_WORD = (1 << 32) - 1, (1 << 16) - 1
STATE = "struct<shard: bigint, next: bigint, high: bigint, low: bigint>"


def _multiplied(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * MULTIPLIER + 1 modulo 2**64, in halves of 32 bits; no product exceeds 62 bits."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & WORD
    first = low.bitwiseAND(HALF_WORD) * F.lit(m_low) + F.lit(1)
    second = F.shiftrightunsigned(low, 16) * F.lit(m_low) + F.shiftrightunsigned(first, 16)
    made_low = F.shiftleft(second.bitwiseAND(HALF_WORD), 16).bitwiseOR(first.bitwiseAND(HALF_WORD))
    upper = F.shiftleft((high * F.lit(m_low >> 16)).bitwiseAND(HALF_WORD), 16) + high * F.lit(m_low & HALF_WORD)
    made_high = (upper + low * F.lit(m_high) + F.shiftrightunsigned(second, 16)).bitwiseAND(WORD)
    return made_high, made_low


def _step(state: Column) -> Column:
    """On to the next shard number of the sequence."""
    high, low = _multiplied(state["high"], state["low"])

    def moved(made: Column) -> Column:
        scale = F.lit(float(1 << FRACTION_BITS)) / (F.shiftrightunsigned(made["high"], 1) + 1).cast("double")
        onward = F.floor((state["next"] + 1).cast("double") * scale).cast("bigint")
        return F.struct(state["next"].alias("shard"), onward.alias("next"), made["high"].alias("high"), made["low"].alias("low")).cast(STATE)

    return let(F.struct(high.alias("high"), low.alias("low")), moved)


def _walk(state: Column, shards: int) -> Column:
    """The state whose `shard` is the last one below `shards`."""
    onward = lambda s, _: F.when(s["next"] >= shards, s).otherwise(_step(s))
    begun = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FIRST_STEPS))), state, onward)
    rest = lambda s: F.when(s["next"] >= shards, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), s, onward))
    return let(begun, rest)


def key_bits(df: DataFrame, key: str) -> Column:
    """The 64 bits a key stands for."""
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    named = F.col(f"`{key}`")
    return F.coalesce(named.cast("bigint"), F.lit(0)) if whole else F.xxhash64(named)


def shard_of(bits: Column, shards: int, grown: int | None = None) -> Column:
    """struct(shard, grown_shard): the shard among `shards`, and among the `grown` there may be later."""
    if shards < 1 or (grown is not None and grown < shards):
        raise ValueError("there is at least one shard, and growing takes none away")
    start = F.struct(
        F.lit(-1).alias("shard"), F.lit(0).alias("next"), F.shiftrightunsigned(bits, 32).alias("high"), bits.bitwiseAND(WORD).alias("low")
    ).cast(STATE)

    def told(at: Column) -> Column:
        later = F.lit(None).cast("int") if grown is None else _walk(at, grown)["shard"].cast("int")
        return F.struct(at["shard"].cast("int").alias("shard"), later.alias("grown_shard"))

    return let(_walk(start, shards), told)


def place(df: DataFrame, key: str, shards: int, grown: int | None = None) -> DataFrame:
    """The rows with `shard` and `grown_shard` behind their own columns; nothing is shuffled."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "grown_shard")]
    at = df.select(*own, shard_of(key_bits(df, key), shards, grown).alias("__at"))
    return at.select(*own, "__at.shard", "__at.grown_shard")


def layout(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (with one shard more) of every document.

    Slots follow doc_id, then size and checksum. One shuffle, of these few columns.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = documents.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
    )
    placed = cut(place(slim, "doc_id", shards, shards + 1))
    return ranked(placed, ["shard"], ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, path: str, key: str, shards: int, spread: int = 8) -> None:
    """Write a folder per shard, each in about `spread` files that are sorted by the key.

    Ranges of shard and key: a shard, or a key with most of the rows, is never one task's.
    """
    placed = place(df, key, shards).drop("grown_shard").withColumn("__salt", F.rand(11))
    ranges = placed.repartitionByRange(shards * spread, "shard", F.col(f"`{key}`"), "__salt")
    ranges.sortWithinPartitions("shard", F.col(f"`{key}`")).drop("__salt").write.partitionBy("shard").parquet(path)


def moved(df: DataFrame, key: str, shards: int, grown: int) -> DataFrame:
    """The rows that leave their shard when there are `grown`, with both numbers. All go to the new shards."""
    return place(df, key, shards, grown).where("grown_shard != shard")
