"""Sets of small whole numbers as bigint words: unions, common members and counts without a row per member."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 64


def words_for(members: int) -> int:
    """Words that hold the numbers below ``members``; at least one."""
    return max(1, -(-members // WIDTH))


def literal_words(members: Iterable[int], words: int) -> list[int]:
    """The set as signed words, on the driver."""
    out = [0] * words
    for m in members:
        out[m // WIDTH] |= 1 << m % WIDTH
    return [w - (1 << WIDTH) if w >> (WIDTH - 1) else w for w in out]


def member_words(member: Column, words: int) -> list[Column]:
    """The set of one number; empty for null."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(member, F.lit(WIDTH)).cast("int"))
    at = F.floor(member / WIDTH)
    return [F.when(at == j, bit).otherwise(F.lit(0).cast("bigint")) for j in range(words)]


def interval_words(first: Column, last: Column, words: int) -> list[Column]:
    """All numbers from ``first`` to ``last``: two shifts a word. Empty when reversed or null."""
    ones = F.lit(-1).cast("bigint")
    out = []
    for j in range(words):
        low, high = F.greatest(first - j * WIDTH, F.lit(0)).cast("int"), F.least(last - j * WIDTH, F.lit(WIDTH - 1)).cast("int")
        span = F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, WIDTH - 1 - high))
        known = first.isNotNull() & last.isNotNull()
        out.append(F.when(known & (low <= high) & (low < WIDTH) & (high >= 0), span).otherwise(F.lit(0).cast("bigint")))
    return out


def union(columns: Sequence[str]) -> list[Column]:
    """Aggregates that unite the sets of a group, under the same names; partial unions are made before a shuffle."""
    return [F.coalesce(F.bit_or(c), F.lit(0).cast("bigint")).alias(c) for c in columns]


def count_common(left: Column, right: Column) -> Column:
    """How many members two sets, as arrays of words, have in common."""
    both = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(both, F.lit(0), lambda n, x: n + x)


def members(columns: Sequence[str], below: int) -> Column:
    """The numbers of a set in rising order, as an array."""
    held = F.array(*[F.col(c) for c in columns])
    every = F.sequence(F.lit(0), F.lit(max(0, below - 1)))
    return F.filter(every, lambda m: F.getbit(F.get(held, F.floor(m / WIDTH).cast("int")), F.pmod(m, F.lit(WIDTH)).cast("int")) == 1)
