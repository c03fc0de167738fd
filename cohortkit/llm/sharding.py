"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortkit.llm.extendible import directory, slot
from cohortkit.session import written

SHARD_BYTES = 64 * 2**20
# Slices of a bucket that no bit can split.
SLICES = 256


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; null as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def assign_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, shard_bits, shard_prefix, shard_part.

    A shard is the rows whose hash starts with the first ``shard_bits`` bits ``shard_prefix``; it holds at
    most ``shard_bytes`` bytes of UTF-8 text. Null texts have no bytes, null ids hash as the empty text. Rows
    that share one id are told apart by no bit: when they exceed the limit, ``shard_part`` numbers their
    parts from 1 (0 elsewhere). Only a single text larger than the limit makes a larger shard, of its own
    part. An empty table gives no rows. Other columns are not read. Runs jobs when called.
    """
    sizes = written(
        docs.select(
            F.col(id_col).alias("id"),
            key_hash(F.col(id_col)).alias("hash"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("weight"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    slots, bits = directory(sizes, shard_bytes)
    found = sizes.withColumn("slot", slot(F.col("hash"), bits)).join(slots.select("slot", "depth", "prefix", "whole"), "slot")
    named = [F.col("id").alias(id_col), F.col("weight").alias("n_bytes"), F.col("depth").alias("shard_bits"), F.col("prefix").alias("shard_prefix")]
    whole = found.where("whole").select(*named, F.lit(0).cast("bigint").alias("shard_part"))

    # Rows of one slice follow each other; a part ends where the sum passes what leaves room for one more row.
    rest = found.where("not whole").withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES)))
    small = F.col("weight") * 2 <= shard_bytes
    lane = Window.partitionBy("depth", "prefix", "slice", small).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(lane), F.lit(0))
    half = max(1, shard_bytes // 2)
    number = F.when(small, F.floor(before / half)).otherwise(F.count(F.lit(1)).over(lane))
    kind = F.when(small, F.lit(0)).otherwise(F.lit(1))
    parts = rest.select(*named, (1 + 2 * (number * SLICES + F.col("slice")) + kind).cast("bigint").alias("shard_part"))
    return whole.unionByName(parts)


def write_shards(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of ``docs`` as one folder per shard and return the assignment.

    Ids must be unique, as rows find their shard by id.
    """
    shards = written(assign_shards(docs, shard_bytes, id_col, text_col), "shards")
    name = F.concat_ws("-", F.col("shard_bits"), F.col("shard_prefix"), F.col("shard_part"))
    key = shards.select(F.col(id_col).alias("_shard_id"), name.alias("_shard"))
    rows = docs.join(key, docs[id_col].eqNullSafe(F.col("_shard_id"))).drop("_shard_id")
    rows.repartition("_shard").write.partitionBy("_shard").parquet(path)
    return shards
