"""Extendible hashing as DataFrame work: which prefix of a hash each bucket covers.

A hash is a bigint of ``HASH_BITS`` bits. The directory of depth b has one slot per prefix of b bits; it
doubles while a slot that could still be split holds more than the limit. A bucket is the shortest prefix
whose weight is within the limit, so only oversized buckets are split on another bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 60
# Bits the directory starts with beyond the evenly filled one, and bits added when it doubles.
SPARE_BITS, MORE_BITS = 3, 8


def slot(hashed: Column, bits: int) -> Column:
    """The first ``bits`` bits of a hash."""
    return F.shiftright(hashed, HASH_BITS - bits)


def directory(entries: DataFrame, limit: int, hashed: str = "hash", weight: str = "weight") -> tuple[DataFrame, int]:
    """(slot, depth, prefix, weight, whole) and the number of bits of a slot.

    ``entries`` should be a written table, as it is read once per doubling. ``whole`` is false for a bucket
    that exceeds the limit though no further bit can split it (all its rows share one hash).
    """
    total = entries.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).first().t
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    while True:
        slots = (
            entries.groupBy(slot(F.col(hashed), bits).alias("slot"))
            .agg(F.sum(weight).alias("weight"), F.min(hashed).alias("_low"), F.max(hashed).alias("_high"))
        )
        splittable = (F.col("weight") > limit) & (F.col("_low") < F.col("_high"))
        if bits == HASH_BITS or slots.where(splittable).isEmpty():
            break
        bits = min(HASH_BITS, bits + MORE_BITS)
    depths = slots.select("slot", "weight", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = depths.withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("weight").alias("_total"))
    fits = (F.col("_total") <= limit) | (F.col("depth") == bits)
    leaves = levels.join(buckets.where(fits), ["depth", "prefix"]).groupBy("slot").agg(F.min(F.struct("depth", "prefix", "_total")).alias("_leaf"))
    return leaves.select("slot", "_leaf.depth", "_leaf.prefix", F.col("_leaf._total").alias("weight"), (F.col("_leaf._total") <= limit).alias("whole")), bits
