"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets,
one of trusted text and one of the whole corpus, give every bucket a log ratio; a document's score is
the mean over its n-grams. A document whose score lies below a bound that depends on its length alone is
rejected; every document is judged, and the same inputs give the same verdicts. Built-in functions only.

The corpus multinomial counts all rows. The trusted one counts the documents with a label of quality
1 that is not toxic, the `TRUSTED_MAX` least by digest of the id: a documented bound, so that their
ids can be broadcast.

Defined cases: a null text has no words. A document without words scores 0. Without any trusted
document no verdict can be drawn and the method keeps everything. Labels repeated for an id count as
trusted if any row is. Repeated documents are counted, and judged, each for itself. Extra columns
are not read; `keep` carries those of the documents through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.llm.words import let, with_window_hashes, word_hashes, words_of

BUCKETS = 1 << 14
TRUSTED_MAX = 20_000
# A document goes if its score is below -(LEVEL + SPREAD / sqrt(words)): the mean of a short text scatters.
LEVEL = 0.035
SPREAD = 0.45
# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

CONTRACT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _buckets(hashes: Column, pairs: Column, n: int) -> Column:
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(n)).cast("int"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_MAX) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The log ratio of every bucket: trusted text against the whole corpus, one added to each count.

    The corpus is reduced to one row per bucket before anything reaches the driver.
    """
    marked = documents.select("doc_id", "text").join(
        F.broadcast(trusted_ids(labels).withColumn("trusted", F.lit(1))), "doc_id", "left"
    )
    grams = let(word_hashes(words_of(F.col("text"))), lambda h: with_window_hashes(h, [2], lambda made: _buckets(h, made[0], buckets)))
    # outer, as a filter on the array would otherwise be put before it and compute it again
    seen = marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode_outer(grams).alias("bucket")).where("bucket IS NOT NULL")
    rows = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("good")).collect()
    raw, good = [0] * buckets, [0] * buckets
    for row in rows:
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    n_raw, n_good = sum(raw) + buckets, sum(good) + buckets
    if n_good == buckets:
        return [0.0] * buckets
    return [math.log((g + 1) / n_good) - math.log((r + 1) / n_raw) for g, r in zip(good, raw)]


def _repeated_words(windows: Column, width: int) -> Column:
    """Words inside windows that occur twice or more: sort the windows, keep those equal to a
    neighbour, and add up what each covers before the next one starts."""

    def neighbours(values: Column, body) -> Column:
        n = F.greatest(F.size(values) - 1, F.lit(0))
        return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), body)

    def covered(starts: Column) -> Column:
        gaps = neighbours(starts, lambda a, b: F.least(b - a, F.lit(width)))
        return F.aggregate(gaps, F.lit(width), lambda acc, x: acc + x)

    def sorted_starts() -> Column:
        indexed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.array().cast("array<int>")
        pairs = let(indexed, lambda x: neighbours(x, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none)))
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    # most texts repeat no window: they are spared the sort
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, let(sorted_starts(), covered)).otherwise(0)


def measures(text: Column, ratios: list[float], buckets: int) -> Column:
    """A struct of the base counts and the score, as one expression that reads the text once."""
    text = F.coalesce(text, F.lit(""))
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counted(hashes: Column) -> Column:
        def made(windows: list[Column]) -> Column:
            pairs, repeat = windows
            n = F.size(hashes)
            total = F.aggregate(_buckets(hashes, pairs, buckets), F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
            return F.struct(
                n.cast("bigint").alias("n_words"),
                F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                let(repeat, lambda x: _repeated_words(x, REPEAT_WINDOW)).cast("bigint").alias("n_repeat_words"),
                F.when(n > 0, total / F.greatest(2 * n - 1, F.lit(1))).otherwise(0.0).alias("score"),
            )

        return with_window_hashes(hashes, [2, REPEAT_WINDOW], made)

    return let(word_hashes(words_of(text)), counted)


def _failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def _likely(m: Column, level: float, spread: float) -> Column:
    return m["score"] >= -(level + spread / F.sqrt(F.greatest(m["n_words"], F.lit(1))))


def judge(documents: DataFrame, labels: DataFrame, level: float = LEVEL, spread: float = SPREAD, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, `score` and the verdict `kept`."""
    m = F.col("m")
    measured = documents.select("doc_id", measures(F.col("text"), fit(documents, labels, buckets), buckets).alias("m"))
    verdicts = {"base_failed": _failed(m), "kept": ~_failed(m) & _likely(m, level, spread)}
    return measured.select("doc_id", "m.*", *[v.alias(k) for k, v in verdicts.items()])


def keep(documents: DataFrame, labels: DataFrame, level: float = LEVEL, spread: float = SPREAD, buckets: int = BUCKETS) -> DataFrame:
    """The documents that are kept, with their own columns."""
    ratios = fit(documents, labels, buckets)
    return documents.where(let(measures(F.col("text"), ratios, buckets), lambda m: ~_failed(m) & _likely(m, level, spread)))
