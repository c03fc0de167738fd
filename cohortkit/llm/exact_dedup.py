"""Exact deduplication by an extendible-hash index kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.extendible import HASH_BITS, directory, slot
from cohortkit.session import written

# Keys per bucket of the index.
BUCKET_KEYS = 100_000
# A key with at least 1/HOT_SHARE of all rows is spread over SPREAD tasks; there are at most HOT_SHARE such keys.
HOT_SHARE, SPREAD = 256, 64


def normalised(text: Column) -> Column:
    """The text with every run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def address(text: Column, hash_bits: int = HASH_BITS) -> Column:
    """The hash that places a text; fewer ``hash_bits`` make texts collide, for tests."""
    cut = F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS)
    return F.shiftleft(F.shiftright(cut, HASH_BITS - hash_bits), HASH_BITS - hash_bits)


def build_index(entries: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Write one index row per key (bucket depth and prefix, hash, rows), every file holding a range of keys.

    Copies are counted before they are shuffled, so a key is one row however often it occurs.
    """
    keys = written(entries.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")), "keys")
    slots, bits = directory(keys.withColumn("weight", F.lit(1).cast("bigint")), bucket_keys)
    placed = keys.withColumn("slot", slot(F.col("hash"), bits)).join(slots.select("slot", "depth", "prefix"), "slot")
    ordered = placed.select("depth", "prefix", "hash", "rows").repartitionByRange("hash").sortWithinPartitions("hash")
    return written(ordered, "index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, hash_bits: int = HASH_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after ``normalised``; null counts as empty. The least id of
    a group stays; null ids come last, and a group with null ids only keeps keep_id null. Rows that repeat
    id and text are counted one by one, and all of them are marked kept when their id stays. An empty table
    gives an empty result. Other columns of ``docs`` are not read, so their names cannot clash.

    Keys that occur more than once chain their texts: the texts of a key are grouped as bytes, so two texts
    that only share a hash stay apart. Runs jobs when called.
    """
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumn("hash", address(F.col("text"), hash_bits))
    entries = written(texts.select("id", "hash", F.unhex(F.sha2("text", 256)).alias("sha")), "entries")
    index = build_index(entries, bucket_keys)
    rows = index.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    # At most HOT_SHARE keys can hold such a share of the rows.
    hot = [r.hash for r in index.where((F.col("rows") * HOT_SHARE >= rows) & (F.col("rows") > 1)).select("hash").collect()]
    is_hot = F.col("hash").isin(hot) if hot else F.lit(False)
    parts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    spread = F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))

    repeated = index.where(F.col("rows") > 1).select("hash", parts.alias("part"))
    chained = texts.withColumn("part", spread).join(repeated.hint("merge"), ["hash", "part"], "left_semi")
    some = chained.groupBy("hash", "part", "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    nodes = some.groupBy("hash", "text").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    chains = nodes.select("hash", F.unhex(F.sha2("text", 256)).alias("sha"), "n", "least")
    links = chains.groupBy("hash", "sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.min("least").alias("least"))
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("n"))
    group = links.select("hash", "sha", checked.cast("bigint").alias("n"), "least").withColumn("part", parts)
    found = entries.withColumn("part", spread).join(group, ["hash", "sha", "part"], "left")
    single = F.col("n").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("least"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
