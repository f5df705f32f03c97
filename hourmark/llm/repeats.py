"""Passages that repeat an earlier document, found by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.

Shards are runs of documents of some megabytes. Sorting every suffix of a corpus to depth LENGTH is
more than its reading costs many times over, so suffixes are sampled first, without loss: of the
grams of GRAM bytes in a window of LENGTH bytes, the one with the least hash is its seed, and equal
windows have equal seeds.

1. Each shard sends the sorted distinct seeds it holds to buckets by hash range, a run per bucket. A
   bucket merges its runs and answers which seeds occur in two documents or more.
2. For these each shard sends the contexts around them: the text of the consecutive windows that have
   this seed, each distinct one once, with its least doc_id. A bucket groups contexts by seed. A seed
   with a single context is settled. The rest are turned into one Burrows-Wheeler transform per
   shard, or for some shards that have few of them, and the transforms are merged by refining their
   interleave: starting from transforms laid one after another, each round sorts the interleave by
   the preceding symbol and steps back, so that after k rounds it is right in the first k symbols
   and the blocks are the suffixes with k symbols in common. After LENGTH rounds the blocks are the
   repeated strings; each window gets the least doc_id of its block. No suffix is sorted again in a
   merge.
3. The answers go back to the shards, which take their contexts again, in the same order, and cover
   the windows that occur in a smaller doc_id.

A seed that very many documents hold is not kept together: its windows are dealt out one by one, by
their own hash. Shards, the seeds that recur and the answers are written to the shared folder, so that
what was shuffled for them can go; contexts are made a second time rather than stored. Where much of
the text recurs, contexts are sent and answered for some of the buckets at a time, which reads the text
again but bounds what is shuffled at once.

Defined cases: a null text is empty. A document without an id neither removes anything nor loses
anything. Rows with the same id do not remove from each other. Texts shorter than LENGTH bytes stay
whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.llm.folders import folder_bytes, remove
from hourmark.runtime import cut, new_path

# Fixed value of the contract.
LENGTH = 50
# Parameters: bytes of a gram and the grams of a window; bytes of a piece of text, of a stride that is
# hashed at a time, and of a shard; the documents, or windows, from which a seed's windows are dealt out
# singly; symbols merged at a time, and of a transform at least; packed bytes of text for every bucket, so that
# buckets grow with the data and not in size; buckets of a task, which has one of them at a time; most tasks of
# a stage. Every shard may send a blob to every bucket, so neither is small.
GRAM = 24
GRAMS = LENGTH - GRAM + 1
PIECE_BYTES = 1 << 20
STRIDE = 1 << 16
SHARD_BYTES = 16 << 20
HOT_DOCS = 50_000
HOT_WINDOWS = 4_000_000
MERGE_SYMBOLS = 1 << 18
TRANSFORM_SYMBOLS = 1 << 15
BUCKET_BYTES = 8 << 20
BUCKETS_PER_TASK = 2
MOST_TASKS = 20_000
TEXT_BATCH, BLOB_BATCH = 256, 32
# Contexts are sent for some of the buckets at a time where more than these bytes of them are expected for a byte
# of packed text; bytes of them for a byte of the seeds that recur.
CONTEXT_SHARE, BYTES_OF_SEED = 2, 9
# Rows and bytes that a task hands on at a time; contexts that are held in words at a time.
SENT_ROWS, SENT_BYTES = 64, 4 << 20
CONTEXTS_AT_ONCE = 1 << 15

POSITION_BITS = 28
SHARD_BITS = 24
SEED_BITS = 48
FILTER_BITS = 22
SEED_MASK = np.uint64((1 << SEED_BITS) - 1)
NO_ID = np.iinfo(np.int64).max


# -- seeds ------------------------------------------------------------------------
def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = _scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes from each position on, put together from halves."""
    powers = {1: BYTE_VALUES[data]}
    n = 1
    while 2 * n <= gram:
        factor = np.uint64(pow(FACTOR, n, 1 << 64))
        powers[2 * n] = powers[n][:-n] * factor + powers[n][n:]
        n *= 2
    made, covered = powers[n], n
    for p in sorted((p for p in powers if p < n and gram & p), reverse=True):
        size = len(data) - covered - p + 1
        made = made[:size] * np.uint64(pow(FACTOR, p, 1 << 64)) + powers[p][covered : covered + size]
        covered += p
    return _scramble(made)


def seed_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, first window, windows) of the runs of consecutive windows with one seed.

    `data` holds documents end to end, `starts` their offsets and the end. Windows lie inside documents.
    Windows are compared by the high bits of hashes. A seed is the low bits, which being least says nothing
    about, so that seeds are spread evenly.
    """
    found = []
    step = STRIDE
    inside = np.zeros(len(data), bool)
    for a, b in zip(starts[:-1], starts[1:]):
        inside[a : max(a, b - LENGTH + 1)] = True
    for at in range(0, len(data), step):
        part = data[at : at + step + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        hashes = gram_hashes(part)
        least = (hashes >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < GRAMS:
            least = np.minimum(least[: len(least) - (GRAMS - width)], least[GRAMS - width :])
        windows = np.flatnonzero(inside[at : at + len(least)])
        if not len(windows):
            continue
        seeds = (least[windows] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        turns = np.flatnonzero((np.diff(seeds) != 0) | (np.diff(windows) != 1)) + 1
        first = np.concatenate(([0], turns))
        count = np.diff(np.concatenate((first, [len(windows)])))
        found.append((hashes[seeds[first]] & SEED_MASK, windows[first] + at, count))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


# -- blobs --------------------------------------------------------------------------
_compressor, _decompressor = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; whole numbers take the narrowest width they fit."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) + a.tobytes())
    return _compressor.compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, arrays = _decompressor.decompress(blob), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        at += 10
        a = np.frombuffer(raw, np.dtype(kind.decode()), n, at)
        at += a.nbytes
        arrays.append(a)
    return arrays


def pack_sorted(values: np.ndarray, *others: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)), *others)


def unpack_sorted(blob: bytes) -> list[np.ndarray]:
    first, *others = unpack(blob)
    return [np.cumsum(first.astype(np.uint64), dtype=np.uint64), *others]


def unpack_text(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes end to end, the offsets of documents and the end, and their ids."""
    data, starts, ids = unpack(blob)
    return data, starts.astype(np.int64), ids.astype(np.int64)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of text as one: bytes, offsets of documents and the end, their ids, and documents before each piece and in all."""
    pieces = [unpack_text(b) for b in blobs]
    shift = np.cumsum([0] + [len(p[0]) for p in pieces])
    starts = np.concatenate([p[1][:-1] + s for p, s in zip(pieces, shift)] + [shift[-1:]])
    return np.concatenate([p[0] for p in pieces]), starts, np.concatenate([p[2] for p in pieces]), np.cumsum([0] + [len(p[2]) for p in pieces])


def _spans(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each span, span after span."""
    ends = np.cumsum(counts)
    return np.repeat(begins - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def _bucket_edges(seeds: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted seeds; buckets are ranges of equal width."""
    bounds = np.array([(b << SEED_BITS) // buckets for b in range(buckets + 1)], np.uint64)
    return np.searchsorted(seeds, bounds)


ROWS = "kind int, shard bigint, part int, blob binary"
COLUMNS = ["kind", "shard", "part", "blob"]
# in the order in which the rows of a shard are read
SEEDS, ANSWERS, TEXT, CONTEXTS = range(4)


def _rows(*rows: tuple) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=COLUMNS)


def _sent(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows some at a time: a frame of each would cost more than what is in it."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= SENT_ROWS or size >= SENT_BYTES:
            yield _rows(*held)
            held, size = [], 0
    if held:
        yield _rows(*held)


def _distinct_docs(seeds: np.ndarray, docs: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct seeds, how many documents each occurs in, and how many windows have it. Documents by number."""
    if docs.max() < 1 << 64 - SEED_BITS:
        order = np.argsort(seeds << np.uint64(64 - SEED_BITS) | docs.astype(np.uint64))
    else:
        order = np.lexsort((docs, seeds))
    seeds, docs = seeds[order], docs[order]
    turns = np.diff(seeds) != 0
    first = np.flatnonzero(np.concatenate(([True], turns)))
    fresh = np.concatenate(([True], turns | (np.diff(docs) != 0)))
    return seeds[first], np.add.reduceat(fresh.astype(np.int64), first), np.add.reduceat(windows[order].astype(np.int64), first)


def _documents(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents to shards: their text in pieces of whole documents."""
    task = TaskContext.get().partitionId()
    shard = part = size = in_shard = 0
    texts: list[bytes] = []
    ids: list[int] = []

    def piece() -> pd.DataFrame:
        data, starts = _documents(texts)
        return _rows((TEXT, task << SHARD_BITS | shard, part, pack(data, starts, np.array(ids, np.int64))))

    for batch in batches:
        for doc_id, value in zip(batch["doc_id"], batch["bytes"]):
            texts.append(bytes(value))
            ids.append(NO_ID if pd.isna(doc_id) else int(doc_id))
            size += len(value)
            if size >= PIECE_BYTES or len(texts) >= 16384:
                yield piece()
                in_shard += size
                part, size, texts, ids = part + 1, 0, [], []
                if in_shard >= SHARD_BYTES:
                    shard, part, in_shard = shard + 1, 0, 0
    if texts:
        yield piece()


def _seeds(buckets: int):
    """Pieces of text to the sorted distinct seeds of what a task reads of each shard, by bucket."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for shard, rows in _grouped(batches, "shard"):
            data, starts, ids, _ = _joined([blob for _, _, _, blob in rows])
            seeds, first, count = seed_runs(data, starts)
            numbers = np.unique(ids, return_inverse=True)[1]
            document = np.searchsorted(starts, first, "right") - 1
            known = ids[document] != NO_ID
            if not known.any():
                continue
            values, counts, held = _distinct_docs(seeds[known], numbers[document[known]], count[known])
            edges = _bucket_edges(values, buckets)
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                yield SEEDS, shard, int(b), pack_sorted(values[part], counts[part], held[part])

    return lambda batches: _sent(found(batches))


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Sorted rows by key, one row at a time; a group must be used up before the next is asked for."""
    rows = (r for batch in batches for r in zip(*(batch[c].tolist() for c in COLUMNS)))
    at = COLUMNS.index(key)
    row = next(rows, None)
    while row is not None:
        value = row[at]

        def members() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[at] == value:
                yield row
                row = next(rows, None)

        yield value, members()


def _recurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bucket: merge the shards' runs of seeds, answer each shard those in two documents or more."""
    return _sent(_again(batches))


def _again(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for bucket, rows in _grouped(batches, "part"):
        runs = [(shard, *unpack_sorted(blob)) for _, shard, _, blob in rows]
        seeds = np.concatenate([r[1] for r in runs])
        order = np.argsort(seeds, kind="stable")
        ordered = seeds[order]
        fresh = np.concatenate(([True], np.diff(ordered) != 0))
        first, of_order = np.flatnonzero(fresh), np.empty(len(seeds), np.int64)
        of_order[order] = np.cumsum(fresh) - 1
        docs, windows = (np.add.reduceat(np.concatenate([r[k] for r in runs]).astype(np.int64)[order], first) for k in (2, 3))
        hot = (docs >= HOT_DOCS) | (windows >= HOT_WINDOWS)
        at = 0
        for shard, values, *_ in runs:
            here = of_order[at : at + len(values)]
            at += len(values)
            again = docs[here] > 1
            if again.any():
                yield SEEDS, shard, int(bucket), pack_sorted(values[again], hot[here][again])


# -- contexts -------------------------------------------------------------------------
WORDS = -(-(LENGTH + GRAMS - 1) // 8)
# the bytes of the words that belong to a context, by its size
_INSIDE = (np.arange(8 * WORDS) < np.arange(8 * WORDS + 1)[:, None]).astype(np.uint8).view(np.uint64) * np.uint64(255)


def _some(n: int) -> Iterator[slice]:
    for at in range(0, n, CONTEXTS_AT_ONCE):
        yield slice(at, min(n, at + CONTEXTS_AT_ONCE))


class _Words:
    """Contexts in a text as words of eight bytes, with zeros behind a context's end."""

    def __init__(self, data: np.ndarray) -> None:
        laid = np.concatenate((data, np.zeros(8 * WORDS, np.uint8)))
        self.at = np.ndarray((len(data) + 1, WORDS), np.uint64, laid, 0, (1, 8))

    def of(self, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.at[begins] & _INSIDE[sizes]

    def digests(self, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        made = np.empty(len(begins), np.uint64)
        for some in _some(len(begins)):
            digest = sizes[some].astype(np.uint64)
            for word in self.of(begins[some], sizes[some]).T:
                digest = _scramble(digest * np.uint64(FACTOR) + word)
            made[some] = digest
        return made

    def unlike(self, begins: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> bool:
        """Whether any context of these differs from the other one of the same size."""
        return any((self.of(begins[s], sizes[s]) != self.of(others[s], sizes[s])).any() for s in _some(len(begins)))


def _distinct(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, keys: np.ndarray, digests: np.ndarray, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of contexts, equal ones having one, in the order of keys; the contexts in this order, and where each
    number begins there. Digests only put together what may be equal; the bytes decide."""
    order = np.lexsort((digests, keys))
    turns = np.ones(len(order), bool)
    turns[1:] = (np.diff(keys[order]) != 0) | (np.diff(digests[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(turns) - 1
    first = np.flatnonzero(turns)
    later = order[~turns]
    same = order[first][number[later]]
    if (sizes[later] != sizes[same]).any() or words.unlike(begins[later], begins[same], sizes[later]):
        raw, found = data.tobytes(), {}
        for i in order.tolist():
            number[i] = found.setdefault((int(keys[i]), raw[begins[i] : begins[i] + sizes[i]]), len(found))
        order = np.argsort(number, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(number[order]) != 0)))
    return number, order, first


class _Shard:
    """A shard: the text, the seeds of it that recur, and the contexts around them; all, or those of some buckets."""

    def __init__(self, only: range | None = None) -> None:
        self.only = only
        self.known: list[list[np.ndarray]] = []
        self.pieces: list[bytes] = []

    def take(self, kind: int, part: int, blob: bytes) -> None:
        if kind == SEEDS:
            seeds, hot = unpack_sorted(blob)
            if self.only is not None and part not in self.only:  # the contexts of hot seeds may be of any bucket
                seeds, hot = seeds[hot.astype(bool)], hot[hot.astype(bool)]
            if len(seeds):
                self.known.append([seeds, hot])
        else:
            self.pieces.append(blob)

    def read(self) -> None:
        """Contexts in the order of the text: begins, windows and numbers. For each number: keys, least and where one of it stands."""
        self.data, self.starts, self.ids, self.documents = _joined(self.pieces)
        self.pieces = []
        found, first, count = seed_runs(self.data, self.starts)
        owner = self.ids[np.searchsorted(self.starts, first, "right") - 1]
        again, hot = np.empty(0, np.int64), np.empty(0, bool)
        if self.known:
            seeds = np.concatenate([k[0] for k in self.known])
            order = np.argsort(seeds, kind="stable")
            seeds = seeds[order]
            low = np.uint64((1 << FILTER_BITS) - 1)
            may = np.zeros(1 << FILTER_BITS, bool)  # most others are told by their low bits
            may[seeds & low] = True
            again = np.flatnonzero(may[found & low] & (owner != NO_ID))
            at = np.minimum(np.searchsorted(seeds, found[again]), len(seeds) - 1)
            recurs = seeds[at] == found[again]
            again, hot = again[recurs], np.concatenate([k[1] for k in self.known]).astype(bool)[order][at[recurs]]
        self.known = []
        keys, begins, windows, docs = (x[again] for x in (found, first, count, owner))
        if hot.any():  # the windows of a hot seed are contexts of their own
            n = np.where(hot, windows, 1)
            begins, windows = _spans(begins, n), np.repeat(np.where(hot, 1, windows), n)
            keys, docs, hot = (np.repeat(x, n) for x in (keys, docs, hot))
        sizes, words = windows + LENGTH - 1, _Words(self.data)
        digests = words.digests(begins, sizes)
        keys = np.where(hot, digests & SEED_MASK, keys)
        self.begins, self.windows = begins, windows
        self.numbers, order, first = _distinct(self.data, begins, sizes, keys, digests, words)
        self.one = order[first]
        self.keys = keys[self.one]
        self.least = np.minimum.reduceat(docs[order], first) if len(first) else docs


def _contexts(buckets: int, only: range | None = None):
    """Per shard: the distinct contexts of recurring seeds, by bucket; of all buckets, or of some."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for number, rows in _grouped(batches, "shard"):
            shard = _Shard(only)
            for kind, _, part, blob in rows:
                shard.take(kind, part, blob)
            shard.read()
            edges = _bucket_edges(shard.keys, buckets)
            for b in np.flatnonzero(np.diff(edges)):
                if only is not None and b not in only:
                    continue
                here = slice(edges[b], edges[b + 1])
                begins, sizes = shard.begins[shard.one[here]], shard.windows[shard.one[here]] + LENGTH - 1
                text = np.concatenate([shard.data[_spans(begins[s], sizes[s])] for s in _some(len(begins))])
                yield CONTEXTS, number, int(b), pack_sorted(shard.keys[here], sizes, shard.least[here], text)

    return lambda batches: _sent(gather(batches))


# -- transforms and their merge ---------------------------------------------------------
def _ranks(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by their first 64 symbols, by doubling; equal ones share a rank."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(4, np.int64)))
    rank = (padded[:n] << 27) | (padded[1 : n + 1] << 18) | (padded[2 : n + 2] << 9) | padded[3 : n + 3]
    rank = np.unique(rank, return_inverse=True)[1]
    width = 4
    while width < LENGTH:
        later = np.concatenate((rank[width:], np.zeros(min(width, n), rank.dtype)))[:n]
        rank = np.unique((rank << 32) | later, return_inverse=True)[1]
        width *= 2
    return rank


def transform(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of some strings, each with an end mark 0 (bytes are 1 to 256).

    Returns (symbol before each suffix in sorted order, where that longer suffix is in this order,
    position of each suffix among the strings laid end to end with their marks).
    """
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.uint16)
    text = np.ones(len(symbols), bool)
    text[ends] = False
    symbols[text] = data.astype(np.uint16) + 1
    suffixes = np.argsort(_ranks(symbols), kind="stable")
    place = np.empty(len(symbols), np.int64)
    place[suffixes] = np.arange(len(symbols))
    previous = np.arange(len(symbols)) - 1
    previous[ends - sizes] = ends  # before the first symbol of a string stands its own mark
    return symbols[previous[suffixes]], place[previous[suffixes]], suffixes


def merge_transforms(parts: list[tuple[np.ndarray, np.ndarray]], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleave transforms (symbols, steps back): (order, block), blocks having `depth` symbols in common.

    `order` numbers the suffixes of all parts, part after part.
    """
    offsets = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
    # ranks of the symbols that occur: a byte holds them, and sorting bytes takes a single pass
    used, symbols = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    symbols = symbols.astype(np.min_scalar_type(len(used)))
    back = np.concatenate([p[1] + o for p, o in zip(parts, offsets)]).astype(np.int32)
    order = np.arange(len(symbols), dtype=np.int32)
    block = np.zeros(len(symbols), np.int32)
    fresh = np.zeros(len(symbols), bool)
    for _ in range(depth):
        before = symbols[order]
        turn = np.argsort(before, kind="stable")
        before, block = before[turn], block[turn]
        order = back[order[turn]]
        np.logical_or(before[1:] != before[:-1], block[1:] != block[:-1], out=fresh[1:])
        block = np.cumsum(fresh, dtype=np.int32)
    return order, block


def least_docs(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For shards of contexts (bytes, sizes, doc_ids): per shard and window the least doc_id among all
    contexts that hold the same window."""
    made = [transform(data, sizes) for data, sizes, _ in shards]
    order, block = merge_transforms([(symbols, back) for symbols, back, _ in made])
    offsets = np.cumsum([0] + [len(m[0]) for m in made])
    position = np.concatenate([m[2] + o for m, o in zip(made, offsets)])[order]
    doc = np.concatenate([np.repeat(ids, sizes + 1) for _, sizes, ids in shards])
    is_window = np.concatenate(
        [np.arange(int((s + 1).sum())) - np.repeat(np.cumsum(s + 1) - s - 1, s + 1) <= np.repeat(s, s + 1) - LENGTH for _, s, _ in shards]
    )
    held = np.where(is_window[position], doc[position], NO_ID)
    first = np.flatnonzero(np.concatenate(([True], np.diff(block) != 0)))
    lowest = np.empty(len(doc), np.int64)
    lowest[position] = np.minimum.reduceat(held, first)[block]
    bounds = np.cumsum([0] + [len(m[0]) for m in made])
    return [lowest[a:b][is_window[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]


def _portions(keys: np.ndarray, symbols: np.ndarray) -> Iterator[slice]:
    """Sorted contexts, some at a time; equal windows are in contexts of one key."""
    if not len(keys):
        return
    first = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))
    before = (np.cumsum(symbols) - symbols)[first] // MERGE_SYMBOLS
    cuts = [*first[np.concatenate(([True], np.diff(before) != 0))].tolist(), len(keys)]
    yield from map(slice, cuts[:-1], cuts[1:])


def _sharing(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which contexts may have a window in common with another one: equal windows have equal hashes, so a context none
    of whose hashes occurs in a second one is settled by itself."""
    ends = np.cumsum(sizes)
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(begins)), windows)
    hashes = gram_hashes(data[_spans(begins, sizes)], LENGTH)[_spans(ends - sizes, windows)]
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(hashes) != 0)))
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    kept = np.zeros(len(begins), bool)
    kept[owner[np.repeat(several, np.diff(np.concatenate((first, [len(owner)]))))]] = True
    return kept


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bucket: the least doc_id of every window of every context, answered to its shard."""
    return _sent(_answers(batches))


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for bucket, rows in _grouped(batches, "part"):
        runs = [(shard, *unpack_sorted(blob)) for _, shard, _, blob in rows]
        keys = np.concatenate([r[1] for r in runs])
        sizes = np.concatenate([r[2] for r in runs]).astype(np.int64)
        docs = np.concatenate([r[3] for r in runs]).astype(np.int64)
        data = np.concatenate([r[4] for r in runs])
        bounds = np.cumsum([0] + [len(r[1]) for r in runs])
        runs = [r[0] for r in runs]
        begins = np.cumsum(sizes) - sizes
        # equal contexts of several shards are one
        words = _Words(data)
        number, order, first = _distinct(data, begins, sizes, keys, words.digests(begins, sizes), words)
        one = order[first]
        least = np.minimum.reduceat(docs[order], first)
        keys, begins, sizes, windows = keys[one], begins[one], sizes[one], sizes[one] - LENGTH + 1
        at = np.cumsum(windows) - windows
        lowest = np.repeat(least, windows)
        # a key with a single context is settled
        turns = np.concatenate(([True], np.diff(keys) != 0, [True]))
        left = np.flatnonzero(~(turns[:-1] & turns[1:]))
        if len(left):
            left = np.concatenate([left[p][_sharing(data, begins[left[p]], sizes[left[p]])] for p in _portions(keys[left], sizes[left])])
        for portion in _portions(keys[left], sizes[left] + 1):
            merged = number[np.sort(one[left[portion]])]  # in the order of the shards
            # a transform of the contexts of a shard, or of some shards that have few
            ends = np.cumsum(sizes[merged] + 1)
            of_run = np.searchsorted(bounds, one[merged], "right")
            turns = np.flatnonzero(np.concatenate(([True], np.diff(of_run) != 0)))
            turns = turns[np.concatenate(([True], np.diff((ends - sizes[merged] - 1)[turns] // TRANSFORM_SYMBOLS) != 0))]
            parts = np.split(merged, turns[1:])
            strings = [(data[_spans(begins[p], sizes[p])], sizes[p], least[p]) for p in parts]
            for p, values in zip(parts, least_docs(strings)):
                lowest[_spans(at[p], windows[p])] = values
        for shard, a, b in zip(runs, bounds[:-1].tolist(), bounds[1:].tolist()):
            here = number[a:b]
            counts = windows[here]
            mine = lowest[_spans(at[here], counts)]
            # runs of windows with one answer: nearly always the whole context
            fresh = np.concatenate(([True], np.diff(mine) != 0))
            fresh[np.cumsum(counts) - counts] = True
            where = np.flatnonzero(fresh)
            yield ANSWERS, shard, int(bucket), pack(counts, np.diff(np.concatenate((where, [len(mine)]))), mine[where])


# -- the result -----------------------------------------------------------------------
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _covered(keep_bytes: bool):
    """Per shard: take the contexts again, look up their answers, and cover what occurs earlier."""

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _grouped(batches, "shard"):
            shard = _Shard()
            counts, lowest = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for kind, _, part, blob in rows:
                if kind == ANSWERS:
                    n, lengths, values = unpack(blob)
                    counts.append(n.astype(np.int64))
                    lowest.append(np.repeat(values.astype(np.int64), lengths.astype(np.int64)))
                else:
                    shard.take(kind, part, blob)
            shard.read()
            windows, answers = np.concatenate(counts), np.concatenate(lowest)
            at = np.cumsum(windows) - windows
            for a, b in zip(shard.documents[:-1].tolist(), shard.documents[1:].tolist()):
                starts, ids = shard.starts[a : b + 1], shard.ids[a:b]
                data = shard.data[starts[0] : starts[-1]]
                here = slice(*np.searchsorted(shard.begins, (starts[0], starts[-1])))
                starts = starts - starts[0]
                gone = np.zeros(len(data), bool)
                if here.start < here.stop:
                    place = shard.numbers[here]
                    window = _spans(shard.begins[here] - shard.starts[a], windows[place])
                    owner = ids[np.searchsorted(starts, window, "right") - 1]
                    marks = np.zeros(len(data) + LENGTH, np.int32)
                    marks[window[answers[_spans(at[place], windows[place])] < owner]] = 1
                    run = np.cumsum(marks, dtype=np.int32)
                    run[LENGTH:] -= run[:-LENGTH].copy()
                    gone = run[: len(data)] > 0
                yield _texts(data, starts, ids, gone, keep_bytes)

    return cover


def _texts(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, gone: np.ndarray, keep_bytes: bool) -> pd.DataFrame:
    rows = []
    for doc_id, a, b in zip(ids.tolist(), starts[:-1].tolist(), starts[1:].tolist()):
        cut = gone[a:b]
        removed = int(cut.sum())
        spans = int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])) if removed else 0
        kept = data[a:b][~cut].tobytes() if removed else data[a:b].tobytes()
        rows.append((None if doc_id == NO_ID else doc_id, b - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})


def _dealt(rows: DataFrame, tasks: int, number: Column, *order: str) -> DataFrame:
    """Rows dealt to tasks by a number, in turn, and sorted there."""
    return rows.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions(*order)


def _stored(rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Rows written to the shared folder and read again, and the folder. What was shuffled for them is deleted."""
    spark, setting = rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = new_path(spark, label), spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        rows.write.option("compression", "none").parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(ROWS).parquet(path), path


def without_repeats(documents: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept
    (null without `keep_bytes`)."""
    return _without_repeats(documents, keep_bytes)[0]


def _without_repeats(documents: DataFrame, keep_bytes: bool) -> tuple[DataFrame, list[str]]:
    """The result, and the folders that it is made from."""
    spark = documents.sparkSession
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, str(TEXT_BATCH))
    plain = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    shards = new_path(spark, "shards")
    plain.mapInPandas(_shards, ROWS).write.option("compression", "none").parquet(shards)
    spark.conf.set(batch, str(BLOB_BATCH))
    text = spark.read.schema(ROWS).parquet(shards)

    # a shard is numbered by the task that made it and its place there
    made, place = F.shiftright("shard", SHARD_BITS), F.col("shard").bitwiseAND(F.lit((1 << SHARD_BITS) - 1))
    many, of_task = text.agg(F.count_distinct("shard"), F.max(place) + 1).first()
    many, of_task = max(1, many), of_task or 1
    buckets = max(1, folder_bytes(spark, shards) // BUCKET_BYTES)

    def by_shard(rows: DataFrame) -> DataFrame:
        return _dealt(rows, min(many, MOST_TASKS), made * of_task + place, "shard", "kind", "part")

    def by_bucket(rows: DataFrame) -> DataFrame:
        tasks = min(-(-buckets // BUCKETS_PER_TASK), MOST_TASKS)
        return _dealt(rows, tasks, F.col("part"), "part")

    again, recurring = _stored(by_bucket(text.mapInPandas(_seeds(buckets), ROWS)).mapInPandas(_recurring, ROWS), "recurring")
    known = text.unionByName(again)
    expected, bearable = BYTES_OF_SEED * folder_bytes(spark, recurring), CONTEXT_SHARE * folder_bytes(spark, shards)
    rounds = min(buckets, max(1, math.ceil(expected / max(1, bearable))))
    folders, answered = [shards, recurring], known
    for r in range(rounds):
        contexts = by_shard(known).mapInPandas(_contexts(buckets, range(buckets * r // rounds, buckets * (r + 1) // rounds)), ROWS)
        answers, folder = _stored(by_bucket(contexts).mapInPandas(_settled, ROWS), "settled")
        folders, answered = [*folders, folder], answered.unionByName(answers)
    return by_shard(answered).mapInPandas(_covered(keep_bytes), RESULT), folders


def judge(documents: DataFrame) -> DataFrame:
    """The digest of `without_repeats`, one row per document."""
    result, folders = _without_repeats(documents, keep_bytes=False)
    result = cut(result.drop("kept"))
    for folder in folders:
        remove(documents.sparkSession, folder)
    return result
