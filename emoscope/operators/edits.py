"""Edit distance of word sequences, bit-parallel.

A column of the distance table differs by at most one from place to place, so
two bit vectors hold it: where it rises and where it falls.  A step to the next
column is a dozen operations on whole vectors, 30 places a machine word, so two
texts of 100,000 words take seconds and memory in proportion to their length.
Words are only looked up in a table of their places, so there is no alphabet and
no limit to it.
"""

from __future__ import annotations

from typing import Hashable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of place masks that are kept; the rest are built as needed.
MASK_BITS = 1 << 28


def _mask(places: list[int], size: int) -> int:
    """An integer with these bits set."""
    if len(places) < 8:
        out = 0
        for p in places:
            out |= 1 << p
        return out
    data = bytearray(size // 8 + 1)
    for p in places:
        data[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(data, "little")


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Least number of insertions, deletions and substitutions that turn ``a`` into ``b``."""
    if len(a) < len(b):
        a, b = b, a
    start, least = 0, len(b)
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    n = len(a)
    if not len(b):
        return n
    wanted = set(b)
    places: dict[Hashable, list[int]] = {}
    for i, w in enumerate(a):
        if w in wanted:
            places.setdefault(w, []).append(i)
    kept: dict[Hashable, int] = {}
    room = MASK_BITS // n
    full, top = (1 << n) - 1, 1 << (n - 1)
    rises, falls, distance = full, 0, n
    for w in b:
        same = kept.get(w)
        if same is None:
            same = _mask(places[w], n) if w in places else 0
            if len(kept) < room:
                kept[w] = same
        diagonal = (((same & rises) + rises) ^ rises) | same | falls
        up = falls | (full & ~(diagonal | rises))
        down = rises & diagonal
        distance += bool(up & top) - bool(down & top)
        up = ((up << 1) | 1) & full
        down = (down << 1) & full
        rises = down | (full & ~(same | falls | up))
        falls = up & (same | falls)
    return distance


def edits(a: Column, b: Column) -> Column:
    """The distance of two arrays, or of two strings by character, as a column, an
    Arrow block of rows at a time; NULL counts as empty."""
    @F.pandas_udf("long")
    def run(blocks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in blocks:
            yield pd.Series([edit_distance([] if x is None else list(x), [] if y is None else list(y))
                             for x, y in zip(left, right)], dtype="int64")

    return run(a, b)


__all__ = ["edit_distance", "edits"]
