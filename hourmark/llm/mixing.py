"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule holds the point frac(k / golden ratio). The points are mapped through the
cumulative weights of the sources, so every source gets its share of any stretch of slots to within
a few slots. What a source still lacks after the last point gets slots of its own at the end, so that
every source takes exactly its quota. The slots of a source are ranked, and rank r takes block r of that
source: the documents of a source, shuffled by digest, laid end to end and cut into blocks of equally many words.
Ranks beyond the last block start over, so a document is taken more than once where its source's
target exceeds its size, and a stretch of it where a block ends inside.

Nothing is ordered in one task: running sums go over pieces of a source and then inside the
pieces, so a source that holds most rows is spread like any other. Built-in functions only.

Defined cases: a null text has no words; a document without words is never taken. A null source is
a source of its own and comes last. Repeated rows are laid out like other rows. An empty table gives
an empty mix. Extra columns are not read; `mix` carries those of the documents through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.llm.words import BLANK_WORD
from hourmark.runtime import cut

# Fixed values of the contract: weights by rank of the source, repeating, and the most passes.
WEIGHTS = [5, 2, 1]
MOST_PASSES = 3
# Parameters: words in a block, blocks that a target is made of at least, pieces a source is summed in,
# slots of a piece of the schedule, cells of the unit interval that points and weights meet in.
BLOCK_WORDS = 128
LEAST_BLOCKS = 32
PIECES = 1024
SLOT_PIECE = 4096
CELLS = 1024
# The golden ratio as a fraction of 2**62, in two halves: slot k holds the point k * GOLDEN / 2**62, modulo 1.
HALF = 31
GOLDEN = 2850178704830799621
GOLDEN_HIGH, GOLDEN_LOW = GOLDEN >> HALF, GOLDEN & ((1 << HALF) - 1)


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, weight, target) from (source, size): shares of all words by weight.

    A target stops at `most` times its source's size and the excess goes to the others by weight.
    That ends where some level L has target = min(most * size, L * weight): order the sources by the
    level at which each stops, and find the first at which what is left suffices for the rest.
    One row per source takes part.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("double"))
    stop = F.col("source_size") * most / F.col("weight")
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("stop", stop)
    ranked = ranked.withColumns(
        {
            "full": F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)),
            "lighter": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "all_words": F.sum("source_size").over(everything),
            "all_weight": F.sum("weight").over(everything),
        }
    )
    # the level if exactly the sources before this one have stopped
    ranked = ranked.withColumn("level", (F.col("all_words") - F.col("full")) / (F.col("all_weight") - F.col("lighter")))
    settled = F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))
    ranked = ranked.withColumn("final", F.min(settled).over(everything)["level"])
    capped = F.least(F.col("source_size") * most, F.col("final") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", F.coalesce(capped, F.lit(0.0)).alias("target"))


def _laid_out(sized: DataFrame, pieces: int) -> DataFrame:
    """Adds `start`, the words of the same source that lie before the document in shuffled order."""
    shuffled = sized.where(F.col("size") > 0).withColumn("piece", F.pmod(F.shiftrightunsigned("mark", 40), F.lit(pieces)))
    in_pieces = shuffled.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_pieces.select("source", "piece", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "piece").orderBy("mark", "doc_id", "row")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    located = shuffled.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    offsets = offsets.withColumnsRenamed({"source": "__source", "piece": "__piece"})
    joined = located.join(offsets, F.col("source").eqNullSafe(F.col("__source")) & (F.col("piece") == F.col("__piece")))
    return joined.select("row", "source", "size", (F.col("before") + F.col("offset")).alias("start"))


def source_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds `blocks`, into which the source is cut, and `quota`, the slots that make up its target.

    The blocks of a source are equally long to within a word, and about `block_words` words; where the
    target is small they are as short as it takes to meet it to within a 64th, or one word.
    """
    filled = F.col("source_size") > 0
    length = F.greatest(F.least(F.lit(block_words), F.floor(F.col("target") / LEAST_BLOCKS)), F.lit(1))
    blocks = F.when(filled, F.greatest(F.round(F.col("source_size") / length), F.lit(1.0)).cast("bigint")).otherwise(0)
    quota = F.when(filled, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint")).otherwise(0)
    return targets.withColumn("blocks", blocks).withColumn("quota", quota)


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2**62, as a fraction below 1.

    In halves, so that no product exceeds 63 bits; 53 bits are kept, which a double holds.
    """
    mask = F.lit((1 << HALF) - 1)
    high, low = F.shiftright(slot, HALF), slot.bitwiseAND(mask)
    upper = F.shiftleft((low * F.lit(GOLDEN_HIGH) + high * F.lit(GOLDEN_LOW)).bitwiseAND(mask), HALF)
    whole = (upper + low * F.lit(GOLDEN_LOW)).bitwiseAND(F.lit((1 << 2 * HALF) - 1))
    return F.shiftright(whole, 2 * HALF - 53) / F.lit(float(1 << 53))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source, rank): which source each slot draws from, and for the how-manieth time.

    `sources` has source and quota. Somewhat more points are drawn than there are slots to fill, as a
    source may lag a few points behind its share; it takes its first `quota` slots. Ranks that no point
    gave it follow in slots behind the last point.
    """
    spark = sources.sparkSession
    needed, fewest = sources.where(F.col("quota") > 0).agg(F.sum("quota"), F.min("quota")).first()
    needed = needed or 0
    extra = min(needed // 8 + 64, 4 * needed // fewest + 64) if needed else 0
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    shares = sources.where(F.col("quota") > 0)
    shares = shares.withColumn("high", F.sum("quota").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    shares = shares.select(
        "source",
        "quota",
        ((F.col("high") - F.col("quota")) / F.lit(float(max(needed, 1)))).alias("low"),
        F.when(F.col("high") == needed, 2.0).otherwise(F.col("high") / F.lit(float(max(needed, 1)))).alias("high"),
    )
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))
    shares = shares.select("source", "quota", "low", "high", F.explode(cells).alias("cell"))
    # golden-ratio points in whole numbers, so that they stay exact however long the schedule
    points = spark.range(needed + extra).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    drawn = points.join(shares, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    drawn = drawn.select("slot", "source", "quota", F.floor(F.col("slot") / SLOT_PIECE).alias("piece"))
    counts = cut(drawn.groupBy("source", "piece").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("source").alias("__source"), F.col("piece").alias("__piece"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("source", "piece").orderBy("slot")) - 1)
    joined = ranked.join(offsets, F.col("source").eqNullSafe(F.col("__source")) & (F.col("piece") == F.col("__piece")))
    rank = F.col("place") + F.col("offset")
    kept = joined.where(rank < F.col("quota")).select("slot", "source", rank.alias("rank"))
    return kept.unionByName(_missing(sources.where(F.col("quota") > 0), counts, needed + extra))


def _missing(sources: DataFrame, counts: DataFrame, slot: int) -> DataFrame:
    """(slot, source, rank) of the ranks that the points left out, from `slot` on. One row per source takes part."""
    had = counts.groupBy(F.col("source").alias("__source")).agg(F.sum("n").alias("n"))
    lacking = sources.join(had, F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lacking = lacking.where(F.col("n") < F.col("quota")).select("source", "quota", "n")
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lacking = lacking.withColumn("start", F.lit(slot) + F.coalesce(F.sum(F.col("quota") - F.col("n")).over(before), F.lit(0)))
    ranks = lacking.select("source", "n", "start", F.explode(F.sequence("n", F.col("quota") - 1)).alias("rank"))
    return ranks.select((F.col("start") + F.col("rank") - F.col("n")).alias("slot"), "source", "rank")


def measured(documents: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, mark): the slim table all sums work on, written once.

    `mark` shuffles; `row` tells rows apart that are equal in all of these, which may change places.
    """
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(BLANK_WORD))).cast("bigint")
    return documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), document_mark().alias("mark"))


def document_mark() -> Column:
    """What orders the documents of a source: a digest of id, source and text, not of how they are stored."""
    return F.xxhash64("doc_id", "source", "text")


def _parts(sized: DataFrame, about: DataFrame, pieces: int) -> DataFrame:
    """(row, source, block, first, after): which words of each document lie in which block of its source."""
    laid = _laid_out(sized, pieces).join(about, F.col("source").eqNullSafe(F.col("__source")))
    end = F.col("start") + F.col("size")
    holding = lambda word: F.floor(((word + 1) * F.col("blocks") - 1) / F.col("source_size"))
    numbers = F.sequence(holding(F.col("start")), holding(end - 1))
    parts = laid.select("row", "source", "source_size", "blocks", "start", end.alias("end"), F.explode(numbers).alias("block"))
    opens = lambda block: F.floor(block * F.col("source_size") / F.col("blocks"))
    first = F.greatest(F.col("start"), opens(F.col("block"))) - F.col("start")
    after = F.least(F.col("end"), opens(F.col("block") + 1)) - F.col("start")
    return parts.select("row", "source", "block", first.alias("first"), after.alias("after"))


def _drawn(sources: DataFrame, about: DataFrame) -> DataFrame:
    """(slot, __source, __block): the block that each slot of the schedule takes."""
    placed = schedule(sources).join(about, F.col("source").eqNullSafe(F.col("__source")))
    return placed.select("slot", "__source", (F.col("rank") % F.col("blocks")).alias("__block"))


# A word and the blanks after it.
WORD_AND_BLANKS = BLANK_WORD + BLANK_WORD.replace("[^", "[").replace("+", "*")
SAME_BLOCK = "source <=> __source AND block = __block"


def taken_words(sized: DataFrame, block_words: int = BLOCK_WORDS, pieces: int = PIECES) -> DataFrame:
    """Every row of `measured` with source_size, target and `taken`, the words the mix takes of it."""
    sources = cut(source_blocks(source_targets(sized), block_words))  # one row per source
    about = sources.withColumnRenamed("source", "__source")
    uses = _drawn(sources, about).groupBy("__source", "__block").agg(F.count(F.lit(1)).alias("times"))
    drawn = _parts(sized, about, pieces).join(uses, F.expr(SAME_BLOCK))
    per_row = drawn.groupBy("row").agg(F.sum((F.col("after") - F.col("first")) * F.col("times")).alias("taken"))
    about = about.select("__source", "source_size", "target")
    out = sized.join(about, F.col("source").eqNullSafe(F.col("__source"))).join(per_row, "row", "left")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    return taken_words(cut(measured(documents)), block_words).drop("row")


def mixed_blocks(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, (slot, doc_id, source, first, after): words `first` up to `after` of a document
    stand in a slot; the slots in order, and in them the rows of a slot, are the mixed corpus."""
    return _placed_parts(documents, block_words).select("slot", "doc_id", "source", "first", "after")


def _placed_parts(documents: DataFrame, block_words: int) -> DataFrame:
    sized = cut(measured(documents))
    sources = cut(source_blocks(source_targets(sized), block_words))
    about = sources.withColumnRenamed("source", "__source")
    drawn = _parts(sized, about, PIECES).join(_drawn(sources, about), F.expr(SAME_BLOCK))
    return drawn.join(sized.select("row", "doc_id", "mark"), "row").select("slot", "doc_id", "source", "first", "after", "mark")


def mixed_text(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed corpus, (slot, doc_id, source, first, after, text): the mix with the words themselves, and
    what follows each of them, as they stand in the document.

    Texts are shuffled once, to the parts that are taken of them; documents of which nothing is taken
    match nothing. Rows with one id, source and text are one text here, and its parts are those of all.
    """
    parts = _placed_parts(documents, block_words).withColumnRenamed("mark", "__mark")
    texts = documents.where(F.col("text").isNotNull()).select(document_mark().alias("mark"), "doc_id", "source", "text").dropDuplicates(["mark"])
    words = F.regexp_extract_all("text", F.lit(WORD_AND_BLANKS), F.lit(0))
    whole = texts.select("mark", words.alias("words"))
    found = parts.join(whole, F.col("mark") == F.col("__mark"))
    text = F.array_join(F.slice("words", (F.col("first") + 1).cast("int"), (F.col("after") - F.col("first")).cast("int")), "")
    return found.select("slot", "doc_id", "source", "first", "after", text.alias("text"))
