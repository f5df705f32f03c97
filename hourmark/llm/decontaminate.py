"""Benchmark decontamination: passages of test items found in training text.

The word windows of the benchmark form a hash set that is broadcast once its bytes have been counted;
beyond the bound hashes are shuffled to it, and texts only to what was found in them. Every window of
every text probes it, and a hit counts only if its words are equal. Built-in functions only, on whole texts.

Defined cases: a null or empty text has no words and no hits. An item of fewer than `window` words,
but not none, is one window; an item without words is never found. An item whose id is null still
marks words, but is neither counted nor listed. Repeated rows each get their own result. Extra
columns of the inputs are not read; `clean` carries those of the documents through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.llm.words import ascii_lower, let, with_window_hashes, word_hashes, words_of
from hourmark.runtime import cut

# Fixed values of the contract: what a word is once A-Z are lower-cased, and the window. The contract
# names the characters that are not of a word; the same class by those that are is matched ten times as fast.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW = 10
# The same words before A-Z are lower-cased, or what separates two of them.
PIECES = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
# Bytes that the table of distinct windows may have and still be sent to every executor.
BROADCAST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    return words_of(ascii_lower(text), WORD)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, length, item_id): the distinct windows of all items."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    grams = F.transform(starts, lambda i: F.slice(F.col("words"), i, length))
    return items.select("item_id", length.alias("length"), F.explode(grams).alias("gram")).distinct()


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def _hashes(words: Column, lengths: list[int]) -> Column:
    """The hashes of all windows of these lengths, those of the first length first."""
    return let(word_hashes(words), lambda h: with_window_hashes(h, lengths, lambda made: F.concat(*made)))


def _start(place: Column, n_words: Column, length: Column, lengths: list[int]) -> Column:
    """Where a window of `length` words begins whose hash stands at `place`; null if it is of another length."""
    windows = {n: F.greatest(n_words - F.lit(n - 1), F.lit(0)) for n in lengths}
    made, before = None, F.lit(0)
    for n in lengths:
        start = place - before
        of_length = (length == n) & (start >= 0) & (start < windows[n])
        made = F.when(of_length, start) if made is None else made.when(of_length, start)
        before = before + windows[n]
    return made


def _broadcast_bytes(table: DataFrame) -> int:
    """What the rows of the window table take in a hash table, more or less: words, items and what holds them."""
    word_bytes = F.aggregate("gram", F.lit(0), lambda n, w: n + F.octet_length(w) + 16)
    return table.agg(F.sum(word_bytes + F.size("items") * 8 + 100)).first()[0] or 0


def find_hits(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, start, length, item_id), distinct: every occurrence of a window in `texts.text`.

    `key` is the digest of the text, so copies of a text are one entry. Windows of all lengths that items
    have are tried in one pass over the texts.
    """
    grams = benchmark_windows(benchmark, window)
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most `window` rows
    schema = "key string, start int, length int, item_id bigint"
    if not lengths:
        return texts.sparkSession.createDataFrame([], schema)
    by_words = grams.groupBy("gram", "length").agg(F.collect_set("item_id").alias("items"))
    own = F.coalesce(*[F.when(F.col("length") == n, F.get(_hashes(F.col("gram"), [n]), F.lit(0))) for n in lengths])
    table = cut(by_words.select(own.alias("hash"), "gram", "length", "items"))

    wordy = texts.where(F.col("text").isNotNull()).select(
        text_key(F.col("text")).alias("key"),
        let(_words(F.col("text")), lambda words: F.struct(words.alias("words"), _hashes(words, lengths).alias("hashes"))).alias("x"),
    )
    start = _start(F.col("place"), F.col("n_words"), F.col("length"), lengths)
    # outer, as a filter on the array would otherwise be put before it and compute it again
    each = F.posexplode_outer("x.hashes").alias("place", "hash")
    same = F.slice("words", F.col("start") + 1, F.col("length")) == F.col("gram")
    if _broadcast_bytes(table) <= BROADCAST_BYTES:
        probes = wordy.select("key", "x.words", F.size("x.words").alias("n_words"), each)
        near = probes.join(F.broadcast(table), "hash").withColumn("start", start)
    else:
        # only hashes are shuffled; the words of a text are brought to what was found in it
        probes = wordy.select("key", F.size("x.words").alias("n_words"), each)
        slim = table.select("hash", "length", "gram", "items")
        found = probes.join(slim, "hash").select("key", start.alias("start"), "length", "gram", "items").where("start IS NOT NULL").distinct()
        near = found.join(wordy.select("key", "x.words").dropDuplicates(["key"]), "key")
    # a condition of its own: as an equality of two sides it would become a key of the join, and every window would be sliced
    here = near.where(F.coalesce(F.when(same, True), F.lit(False)))
    return here.select("key", "start", "length", F.explode_outer("items").alias("item_id")).distinct()


def hits_by_text(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, positions, items) per distinct text with a hit; both arrays are bounded by the text.

    Cut, so that a text with many copies is a partition of a join that can be split, not of a sum.
    """
    hits = find_hits(texts, benchmark, window)
    covered = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    by_text = hits.groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("item_id").alias("items"))
    return cut(by_text.select("key", F.array_distinct(F.flatten(covered)).alias("positions"), "items"))


def judge(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits_by_text(documents, benchmark, window)
    counted = documents.select(
        "doc_id",
        F.coalesce(text_key(F.col("text")), F.lit("")).alias("key"),
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD))).cast("bigint").alias("n_words"),
    )
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    n_hit = F.coalesce(F.size("positions"), F.lit(0)).cast("bigint")
    summary = found.select("key", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), names.alias("names"))
    return counted.join(summary, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """The documents, their columns unchanged, without what the benchmark contains.

    remove="documents" drops every document with a hit; remove="spans" cuts the words that are hit
    (and what stands between two of them) out of the text and keeps the document.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = hits_by_text(documents, benchmark, window).select("key", F.array_sort("positions").alias("positions"))
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own")
    keyed = documents.select(own, F.coalesce(text_key(F.col("text")), F.lit("")).alias("key"))
    if remove == "documents":
        return keyed.join(found, "key", "left_anti").select("own.*")
    joined = keyed.join(found, "key", "left")
    # Words and what stands between them, by turns: word k is piece 2k, or 2k + 1 if the text opens with
    # a separator. The separator between two words that go, goes too.
    text = F.col("own.text")
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    opening = F.when(text.rlike(f"^{PIECES.split('|')[0]}"), 0).otherwise(1)
    followed = F.array_intersect("positions", F.transform("positions", lambda p: p - 1))
    gone = F.array_union(F.transform("positions", lambda p: p * 2 + opening), F.transform(followed, lambda p: p * 2 + opening + 1))
    left = let(gone, lambda g: F.filter(pieces, lambda _, i: ~F.array_contains(g, i)))
    without = F.when(F.col("positions").isNull(), text).otherwise(F.array_join(left, ""))
    return joined.select(F.col("own").withField("text", without).alias("own")).select("own.*")
