"""Near-duplicates by SimHash, with candidates from the pigeonring principle.

A fingerprint is cut into eight segments that stand in a ring. If two fingerprints differ in at most
three bits, then from some segment on every chain of l consecutive segments differs in at most
3 l / 8 bits: 0, 0, 1, 1, 1, 2, 2, 3. So the first two segments of the chain are equal, and two of the
next three: 24 choices of four equal segments, which are the keys of an equi-join. What meets under a
key must keep to the budgets of its chain before the whole distance is looked at.

Fingerprints are made distinct first, so copies cost nothing. Under a key the links are found as a
spanning forest, not as pairs: from each fingerprint reached, only those not reached yet are tried.
A very full key is divided further by the segments it leaves open.

Defined cases: a null or empty text, or one without words, has the fingerprint zero and is linked
like any other. Fewer than three words are one shingle. Repeated rows each get their row. A row
without an id takes part; a component of such rows alone has no id. Extra columns are not read;
`deduplicate` carries those of the documents through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourmark.llm.graph import components
from hourmark.runtime import cut

# Fixed values of the contract.
SHINGLE = 3
SEED = 42
DISTANCE = 3
# Segments of the ring, and the size from which the members of a key are divided.
SEGMENTS = 8
BITS = 64 // SEGMENTS
CROWDED = 8192
BATCH = 512

BUDGETS = [length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS + 1)]


def _ring(start: int, length: int) -> list[int]:
    return [(start + k) % SEGMENTS for k in range(length)]


def _mask(segments) -> int:
    return sum(((1 << BITS) - 1) << (BITS * s) for s in segments)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# (start of the chain, bits that are equal): the first two segments, and two of the next three.
KEYS = [
    (start, _mask(ring[:2] + [s for s in ring[2:] if s != left_out]))
    for start in range(SEGMENTS)
    for ring in [_ring(start, 5)]
    for left_out in ring[2:]
]
CHAINS = {start: [(_mask(_ring(start, n)), BUDGETS[n - 1]) for n in range(3, SEGMENTS)] for start in range(SEGMENTS)}


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(documents: DataFrame) -> DataFrame:
    """The documents with `fp`, their fingerprint as a signed bigint."""
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    @F.pandas_udf("bigint")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return documents.withColumn("fp", made("text"))


def _close(one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Which of `others` are linked to `one`: the chain from `start` within its budgets, then all bits."""
    differing = others ^ one
    viable = np.ones(len(others), bool)
    for mask, budget in CHAINS[start]:
        viable &= np.bitwise_count(differing & np.uint64(mask)) <= budget
    at = np.flatnonzero(viable)
    return at[np.bitwise_count(differing[at]) <= DISTANCE]


def _forest(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    links, waiting = [], members
    while len(waiting) > 1:
        reached, waiting = [waiting[0]], waiting[1:]
        while reached and len(waiting):
            one = reached.pop()
            found = _close(one, waiting, start)
            if len(found):
                links += [(int(one), int(x)) for x in waiting[found]]
                reached += list(waiting[found])
                waiting = np.delete(waiting, found)
    return links


def _groups(members: np.ndarray, mask: int) -> Iterator[np.ndarray]:
    values = members & np.uint64(mask)
    order = np.argsort(values, kind="stable")
    edges = np.flatnonzero(np.diff(values[order])) + 1
    yield from (g for g in np.split(members[order], edges) if len(g) > 1)


def spanning_links(members: np.ndarray, start: int, open_bits: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is linked among the distinct `members`, which agree but in `open_bits`.

    Three differences leave one of four parts of the open bits equal, so crowded members are grouped
    by each part in turn. Few open bits cannot hold more than CROWDED members.
    """
    if len(members) <= CROWDED:
        return _forest(members, start)
    links = []
    size = -(-len(open_bits) // (DISTANCE + 1))
    for at in range(0, len(open_bits), size):
        part = open_bits[at : at + size]
        rest = [b for b in open_bits if b not in part]
        for group in _groups(members, sum(1 << b for b in part)):
            links += spanning_links(group, start, rest)
    return links


def _link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; a run of one key may go over several batches."""
    held: pd.DataFrame | None = None

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        key, choice, fp = rows["key"].to_numpy(), rows["choice"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(choice) != 0)) + 1
        starts = np.concatenate(([0], edges))
        ends = np.concatenate((edges, [len(key)]))
        links = []
        for i in np.flatnonzero(ends - starts > 1):
            start, mask = KEYS[choice[starts[i]]]
            open_bits = [b for b in range(64) if not mask >> b & 1]
            links += spanning_links(np.unique(fp[starts[i] : ends[i]]), start, open_bits)
        made = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": made[:, 0], "b": made[:, 1]})

    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch["key"].iloc[-1]
        if waiting and waiting[0]["key"].iloc[0] == last and batch["key"].iloc[0] == last:
            waiting.append(batch)
            continue
        at = int(np.searchsorted(batch["key"].to_numpy(), last))
        held = pd.concat([*waiting, batch.iloc[:at]])
        if len(held):
            yield linked(held)
        waiting = [batch.iloc[at:]]
    if waiting:
        yield linked(pd.concat(waiting))


def near_links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) between fingerprints at most three bits apart, enough of them to connect all that are.

    `fingerprints` has distinct values in `fp`.
    """
    choices = [
        F.struct(F.lit(n).alias("choice"), F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(_signed(mask)))).alias("key"))
        for n, (_, mask) in enumerate(KEYS)
    ]
    keyed = fingerprints.select("fp", F.explode(F.array(*choices)).alias("x")).select("x.key", "x.choice", "fp")
    runs = keyed.repartition("key").sortWithinPartitions("key", "choice")
    return runs.mapInPandas(_link_runs, "a bigint, b bigint").distinct()


def classes(fingerprinted: DataFrame) -> DataFrame:
    """(fp, class, component_id) from (doc_id, fp): the component's least fingerprint and least doc_id."""
    least = cut(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    found = components(near_links(least.select("fp")))
    labelled = least.join(found, F.col("fp") == F.col("node"), "left").withColumn("class", F.coalesce("component", "fp"))
    ids = labelled.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return labelled.select("fp", "class").join(ids, "class").select("fp", "class", "component_id")


def _written(documents: DataFrame) -> DataFrame:
    """(doc_id, fp), written once: the texts are read and hashed a single time."""
    return cut(with_fingerprints(documents.select("doc_id", "text")).select("doc_id", "fp"))


def judge(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    slim = _written(documents)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return slim.join(classes(slim), "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame) -> DataFrame:
    """One document of each component: the one with the least id, of repeated ids the least fingerprint.

    The columns are those of the documents, whatever their names.
    """
    slim = _written(documents)
    found = cut(classes(slim))
    ids = slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"))
    once = ids.where((F.col("n") == 1) & F.col("doc_id").isNotNull()).join(found, "fp").where(F.col("doc_id") == F.col("component_id"))
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own_row")
    rows = documents.select(own, "doc_id", "text")
    plain = rows.join(once.select("doc_id"), "doc_id", "left_semi").select("own_row.*")
    # rows that their id does not tell apart are few: their fingerprints are made again
    shared = ids.where((F.col("n") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("__id"))
    if shared.isEmpty():
        return plain
    again = with_fingerprints(rows.join(shared, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")).join(found, "fp")
    again = again.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = F.row_number().over(Window.partitionBy("class").orderBy("fp", F.xxhash64("text"), F.xxhash64("own_row")))
    return plain.unionByName(again.withColumn("place", first).where("place = 1").select("own_row.*"))
