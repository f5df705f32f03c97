"""Conversations without quotations: quoted lines are linked to the message they come from.

A line that opens with `>` marks is a quotation, nested as deep as it has marks. Quoted lines are
normalised (marks off, blanks squeezed, lower case), hashed, and joined to the first message of the
same conversation that wrote such a line itself. A line that meets none may have been wrapped anew or cut out
of a longer one: adjacent quoted lines of one depth are joined to a passage, and its sentences are joined to
those the messages wrote themselves; the line comes from the message that most of its sentences come from,
and counts as linked if all of them are found. A message answers the message most of its outermost
quoted lines come from, the latest on a tie; that gives reply_to, the root of its thread and its depth
in it. Quoted lines, and an attribution right before them ("… wrote:"), are taken out of the text; those that
are linked to nothing (they may be prompts or block quotes) are kept in the column `unlinked`, with their places.

Every quoted line meets one original line at most, as originals are reduced to the first per
conversation and hash before the join, and so is every sentence; no pairs of a conversation are formed.
Built-in functions only.

Defined cases: a null text is empty. A message without conv_id or turn is linked to nothing. Blank
lines are never linked. A part of a sentence is linked to nothing. A message never answers itself or a later one. Messages of one conversation and
turn count as one message when they are quoted; rows that are repeated each get their row. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.llm.words import let
from hourmark.runtime import cut, is_small

MARKS = r"^[ \t]*>[> \t]*"
SENTENCE_END = r"[.!?][\"')\]]{0,2}$"
ATTRIBUTION = r"^.{0,200}\b(wrote|writes|said):[ \t]*$"


def level(line: Column) -> Column:
    """How many marks open the line."""
    return F.regexp_count(F.regexp_extract(line, MARKS, 0), F.lit(">"))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"\s+", " "))


def _digest(text: Column) -> Column:
    """128 bits of the text's SHA-256, as bytes: a quarter of what it takes as hex."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


MESSAGE = ["conv_id", "turn", "mark"]


def _known(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, text) of the messages that can be linked; `mark` is the text's digest."""
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    return known.select("conv_id", "turn", _digest(F.col("text")).alias("mark"), "text")


def _lines(messages: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, turn, mark, place, level, hash) of every line that is not blank, quoted or not."""
    split = messages.select(*MESSAGE, F.posexplode_outer(F.split("text", "\n", -1)).alias("place", "line"))
    split = split.where(F.col("line").rlike(MARKS) if quoted else ~F.col("line").rlike(MARKS))
    known = split.select(*MESSAGE, "place", level(F.col("line")).alias("level"), normalised(F.col("line")).alias("words"))
    return known.where("words <> ''").withColumn("hash", _digest(F.col("words"))).drop("words")


def _sentences(words: Column) -> Column:
    """(hash, begin, n) of the sentences of an array of words, `begin` counted from 1."""
    n = F.size(words)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.get(words, i - 1).rlike(SENTENCE_END))
    begins = F.concat(F.array(F.lit(1)), F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda i: i + 1))
    bounds = F.arrays_zip(begins.alias("begin"), ends.alias("end"))
    span = lambda x: x["end"] - x["begin"] + 1
    return F.transform(
        bounds, lambda x: F.struct(F.xxhash64(F.slice(words, x["begin"], span(x))).alias("hash"), x["begin"].alias("begin"), span(x).alias("n"))
    )


def _written(messages: DataFrame) -> DataFrame:
    """(conv_id, hash, source): the first message that wrote a sentence itself."""
    own = F.filter(F.split("text", "\n", -1), lambda line: ~line.rlike(MARKS))
    words = messages.select("conv_id", "turn", F.split(normalised(F.array_join(own, " ")), " ").alias("words"))
    said = words.select("conv_id", "turn", F.explode(F.array_distinct(_sentences(F.col("words"))["hash"])).alias("hash"))
    return said.groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))


def _passages(text: Column) -> Column:
    """(words, places) of the passages of a text, `places` with the line of every word: adjacent quoted lines
    of one level that are not blank. Found inside the row, so no text is shuffled."""

    def found(lines: Column) -> Column:
        at = lambda i: F.coalesce(F.get(lines, i)["level"], F.lit(0))
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        begins = F.filter(numbers, lambda i: (at(i) > 0) & (at(i - 1) != at(i)))
        ends = F.filter(numbers, lambda i: (at(i) > 0) & (at(i + 1) != at(i)))

        def passage(x: Column) -> Column:
            held = F.slice(lines, x["begin"] + 1, x["end"] - x["begin"] + 1)
            places = F.transform(held, lambda line, k: F.array_repeat(x["begin"] + k, F.size(line["words"])))
            return F.struct(F.flatten(F.transform(held, lambda line: line["words"])).alias("words"), F.flatten(places).alias("places"))

        return F.transform(F.arrays_zip(begins.alias("begin"), ends.alias("end")), passage)

    def known(line: Column) -> Column:
        words = lambda w: F.struct(F.when(w != "", level(line)).otherwise(0).alias("level"), F.split(w, " ").alias("words"))
        return F.when(line.rlike(MARKS), let(normalised(line), words))

    return let(F.transform(F.split(text, "\n", -1), known), found)


def _quoted_sentences(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, place, hash): the sentences of passages, at every line they reach into."""

    def said(passage: Column) -> Column:
        reached = lambda s: F.array_distinct(F.slice(passage["places"], s["begin"], s["n"]))
        return F.transform(_sentences(passage["words"]), lambda s: F.struct(s["hash"].alias("hash"), reached(s).alias("places")))

    quoting = messages.where(F.contains(F.col("text"), F.lit(">")))
    sentences = quoting.select(*MESSAGE, F.explode(F.flatten(F.transform(_passages(F.col("text")), said))).alias("s"))
    return sentences.select(*MESSAGE, F.explode("s.places").alias("place"), F.col("s.hash").alias("hash"))


def _narrowed(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """The messages with a row of `asked`, or all of them where that is too large to be broadcast: the rest
    meets nothing later on, and leaving it in moves less than shuffling the texts."""
    return messages.join(F.broadcast(asked), asked.columns, "left_semi") if is_small(asked) else messages


def _votes(messages: DataFrame, unlinked: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, place, voted, n): how many sentences of the passage at a line an earlier message wrote
    first, `voted` null for those that none did. Of copies of a message all are counted."""
    first = _written(_narrowed(messages, unlinked.select("conv_id").distinct()))
    said = _quoted_sentences(_narrowed(messages, unlinked.select(*MESSAGE).distinct()))
    found = said.join(first, ["conv_id", "hash"], "left")
    found = found.withColumn("voted", F.when(F.col("source") < F.col("turn"), F.col("source")))
    # with the key of the join among its own, this needs no shuffle
    return found.groupBy(*MESSAGE, "place", "voted", "hash").agg(F.count(F.lit(1)).alias("n")).drop("hash")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, n_linked, reply_to, linked): per message with quoted lines; `linked` has the
    places of those that are linked. Rows between the steps have no text; they are shuffled by message once."""
    known = _known(messages)
    first = _lines(known, quoted=False).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = _lines(known, quoted=True).join(first, ["conv_id", "hash"], "left")
    quoted = quoted.withColumn("direct", F.when(F.col("source") < F.col("turn"), F.col("source")))
    # one row per line of a message, however often the message is repeated; again with the key of the join
    quoted = cut(quoted.groupBy(*MESSAGE, "place", "level", "hash").agg(F.max("direct").alias("direct")).drop("hash"))
    both = quoted.withColumns({"voted": F.lit(None).cast(quoted.schema["turn"].dataType), "n": F.lit(0).cast("bigint")})
    unlinked = quoted.where("direct IS NULL")
    if not unlinked.isEmpty():
        both = both.unionByName(_votes(known, unlinked), allowMissingColumns=True)
    asked = both.repartition(*MESSAGE).groupBy(*MESSAGE, "place", "voted").agg(
        F.max("level").alias("level"), F.max("direct").alias("direct"), F.sum("n").alias("n")
    )
    best = F.max(F.when(F.col("voted").isNotNull(), F.struct("n", "voted")))
    lines = asked.groupBy(*MESSAGE, "place").agg(
        F.max("level").alias("level"), F.max("direct").alias("direct"), best.alias("best"),
        F.every(F.col("voted").isNotNull() | (F.col("n") == 0)).alias("all_found"),
    )
    lines = lines.where("level IS NOT NULL").withColumns(
        {"source": F.coalesce("direct", "best.voted"), "whole": F.col("direct").isNotNull() | (F.col("best").isNotNull() & F.col("all_found"))}
    )
    votes = lines.groupBy(*MESSAGE, "source").agg(
        F.collect_list(F.when(F.col("whole"), F.col("place"))).alias("places"), F.count_if("whole").alias("n"), F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("outer")
    )
    answered = F.max(F.when((F.col("outer") > 0) & F.col("source").isNotNull(), F.struct("outer", "source")))
    return votes.groupBy(*MESSAGE).agg(
        F.sum("n").alias("n_linked"), answered["source"].alias("reply_to"), F.flatten(F.collect_list("places")).alias("linked")
    )


def threads(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) from (conv_id, turn, reply_to), by doubling the reach of every
    message that does not stand at a root yet; each round is written to the shared folder."""
    reach = answers.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("root")).where("root IS NOT NULL")
    moving = cut(reach.select("*", F.lit(1).cast("bigint").alias("depth"), F.lit(True).alias("open")))
    placed = moving.where("NOT open")
    while not moving.where("open").isEmpty():
        # what stands at its root is not written again
        reach = placed.unionByName(moving.where("open"))
        ahead = reach.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moving = cut(
            moving.where("open").drop("open").join(ahead, ["conv_id", "root"], "left").select(
                "conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("next").isNotNull().alias("open"),
            )
        )
        placed = placed.unionByName(moving.where("NOT open"))
    return placed.drop("open")


def without_quotes(text: Column) -> Column:
    """The text without quoted lines and the attributions right before them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit("")))
    pairs = F.arrays_zip(lines.alias("line"), after.alias("after"))
    quoted = lambda line: line.rlike(MARKS)
    kept = F.filter(pairs, lambda p: ~quoted(p["line"]) & ~(p["line"].rlike(ATTRIBUTION) & quoted(p["after"])))
    return F.array_join(F.transform(kept, lambda p: p["line"]), "\n")


def unlinked_lines(text: Column, linked: Column) -> Column:
    """(place, line) of the lines that `without_quotes` takes out and that are linked to nothing: quoted
    lines that are not blank, and attributions right before such a line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit("")))
    placed = F.transform(F.arrays_zip(lines.alias("line"), after.alias("after")), lambda p, i: F.struct(i.alias("place"), p["line"].alias("line"), p["after"].alias("after")))
    free = lambda line, place: line.rlike(MARKS) & (normalised(line) != "") & ~F.array_contains(linked, place)
    lost = lambda p: free(p["line"], p["place"]) | (
        ~p["line"].rlike(MARKS) & p["line"].rlike(ATTRIBUTION) & free(p["after"], p["place"] + 1)
    )
    return F.transform(F.filter(placed, lost), lambda p: F.struct(p["place"].alias("place"), p["line"].alias("line")))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, root, depth, n_quoted, n_linked, text, unlinked.

    Ordered by conv_id, root, depth and turn, a conversation reads in reply order.
    """
    found = cut(links(messages))
    placed = threads(found.select("conv_id", "turn", "reply_to"))
    # brought together without the texts, which are shuffled once and taken apart only then
    mark = F.coalesce(_digest(F.col("text")), F.lit(b"")).alias("mark")
    about = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", mark).distinct()
    about = about.join(found, MESSAGE, "left").join(placed, ["conv_id", "turn"], "left")
    about = about.where("n_linked IS NOT NULL OR root IS NOT NULL")
    n_quoted = F.size(F.filter(F.split(F.coalesce("whole", F.lit("")), "\n", -1), lambda line: line.rlike(MARKS)))
    own = messages.select("conv_id", "turn", "role", mark, F.col("text").alias("whole"))
    return (
        own.join(about, MESSAGE, "left")
        .select(
            "conv_id", "turn", "role", "reply_to",
            F.coalesce("root", "turn").alias("root"),
            F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
            n_quoted.cast("bigint").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
            without_quotes(F.col("whole")).alias("text"),
            unlinked_lines(F.col("whole"), F.coalesce("linked", F.array().cast("array<int>"))).alias("unlinked"),
        )
    )


def quoting_replies(messages: DataFrame) -> DataFrame:
    """The messages as a mail reader would send them: each quotes the message of the turn before it,
    and within that the first line of the one before. By turn the quoted message keeps its lines, is wrapped
    anew, or is cut to the second sentence of each line. For tests and the registered query."""
    first = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    # what a message is given by the two before it, brought together in one shuffle
    given = F.array(
        F.struct((F.col("turn") + 1).alias("turn"), F.col("said").alias("before"), F.lit(None).cast("string").alias("earlier")),
        F.struct((F.col("turn") + 2).alias("turn"), F.lit(None).cast("string").alias("before"), F.split("said", "\n", -1)[0].alias("earlier")),
    )
    given = first.select("conv_id", F.inline(given)).groupBy("conv_id", "turn").agg(F.max("before").alias("before"), F.max("earlier").alias("earlier"))
    joined = messages.join(given, ["conv_id", "turn"], "left")
    wrapped = lambda line: F.regexp_replace(line, r"(.{60,}?)[ \t]+", "$1\n> ")
    # only where it has enough words to be told from others
    sentence = lambda line: F.regexp_extract(line, r"[.!?] +((?:[^ .!?]+ +){5,}[^ .!?]+[.!?])", 1)
    kind = F.pmod(F.col("turn"), F.lit(3))
    shown = lambda line: F.when(kind == 1, wrapped(line)).when((kind == 2) & (sentence(line) != ""), sentence(line)).otherwise(line)
    outer = F.array_join(F.transform(F.split("before", "\n", -1), lambda line: F.concat(F.lit("> "), shown(line))), "\n")
    inner = F.coalesce(F.concat(F.lit(">> "), F.col("earlier"), F.lit("\n")), F.lit(""))
    text = F.when(F.col("before").isNotNull(), F.concat(F.lit("Somebody wrote:\n"), inner, outer, F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return joined.select("conv_id", "turn", "role", text.alias("text"))
