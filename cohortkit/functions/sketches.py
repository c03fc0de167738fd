"""A set of keys as a table of bits whose size is fixed: cheap to broadcast, never wrong about a key it lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the table, in rows of 64: at most 131,072 rows, however many keys there are.
SLOTS = 2**23


def _slot(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


def key_bits(keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_word, _bits) of the slots of all keys."""
    slots = keys.select(_slot(columns).alias("_slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_slot", F.lit(64)).cast("int"))
    return slots.groupBy(F.floor(F.col("_slot") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def with_maybe(rows: DataFrame, bits: DataFrame, columns: Sequence[str], name: str = "_maybe") -> DataFrame:
    """``rows`` with a flag: false says that a row's key is certainly not in the set.

    The columns must have the types of the keys, as equal numbers of other types have other hashes.
    """
    marked = rows.withColumn("_slot", _slot(columns))
    # Bounded by SLOTS, so it may always be broadcast.
    met = marked.join(F.broadcast(bits), F.floor(F.col("_slot") / 64) == F.col("_word"), "left")
    held = F.coalesce(F.getbit("_bits", F.pmod("_slot", F.lit(64)).cast("int")), F.lit(0)) == 1
    return met.select(*rows.columns, held.alias(name))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
