"""Column helpers on words that several operators share. Built-in functions only."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept. `lower` does that for pure ASCII, and faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: Column, pattern: str = BLANK_WORD) -> Column:
    """All matches of `pattern` in order; none for a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it and wherever the
    optimizer moves the whole expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(hashes: Column, skip: int, length: Column) -> Column:
    return F.slice(hashes, F.lit(1 + skip), F.greatest(length, F.lit(0)))


def with_window_hashes(hashes: Column, sizes: list[int], body: Callable[[list[Column]], Column]) -> Column:
    """`body` of the hashes of all windows of so many words, in order, one array for each of `sizes`.

    `hashes` is an array of word hashes that costs nothing to name. Windows of 1, 2, 4 … words are
    combined from halves, so a window of n words takes some log n steps, whatever n is.
    """
    count = F.size(hashes)

    def both(first: Column, second: Column, covered: int, n: int) -> Column:
        length = count - F.lit(n - 1)
        return F.zip_with(_part(first, 0, length), _part(second, covered, length), lambda a, b: F.xxhash64(a, b))

    def whole(powers: dict[int, Column], wanted: int) -> Column:
        parts = [p for p in sorted(powers, reverse=True) if wanted & p]
        made, covered = powers[parts[0]], parts[0]
        for p in parts[1:]:
            made = both(made, powers[p], covered, covered + p)
            covered += p
        return made

    def doubled(powers: dict[int, Column]) -> Column:
        n = max(powers)
        if 2 * n > max(sizes):
            return body([whole(powers, wanted) for wanted in sizes])
        return let(both(powers[n], powers[n], n, 2 * n), lambda made: doubled({**powers, 2 * n: made}))

    return doubled({1: hashes})
