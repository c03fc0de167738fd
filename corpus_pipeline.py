"""The corpus pipeline: toxicity, quality, exact dedup, near dedup, packing, each over what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``docs``. Labels come from ``sf_dir``; rows without a
label are judged like the others. Null texts count as empty, null ids as ids of their own; an empty table
passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from cohortkit.llm import exact_dedup, near_dedup, packing, quality, toxicity
from cohortkit.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# A document goes when its toxicity reaches the one, or its quality stays below the other.
TOXIC, QUALITY = 0.5, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples do not mark them as toxic."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # A score depends on the text alone; the id spreads the rows of a text with many copies.
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    scored = toxicity.score(docs.select("doc_id", "text", key.alias("_key")), index, more=["_key"])
    toxic = scored.where(F.col("score") >= TOXIC).select(F.col("doc_id").alias("_id"), "_key").distinct()
    return docs.join(toxic.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_anti")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    ensemble = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # A filter on the score itself would be pushed below the statistics, each of which is then computed once per rule.
    scored = quality.add_score(docs, ensemble, "_quality").withColumn("_judged", F.explode(F.array("_quality")))
    return scored.where(F.col("_judged") >= QUALITY).drop("_quality", "_judged")


def _one_each(docs: DataFrame, key: Column, chosen: DataFrame, others: Column) -> DataFrame:
    """The rows of ``docs`` that (id, key) of ``chosen`` names, each pair once, and those where ``others`` holds.

    ``rows`` of ``chosen`` tells how many rows a pair has. Only pairs with several rows are looked at again; the
    key spreads the rows of an id, null included.
    """
    marked = docs.withColumn("_key", key)
    named = chosen.select(F.col("id").alias("_id"), F.col("key").alias("_k"), "rows").hint("merge")
    found = marked.join(named, marked["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left").where(F.col("rows").isNotNull() | others)
    once = found.where(F.col("rows").isNull() | (F.col("rows") == 1))
    repeated = found.where(F.col("rows") > 1).dropDuplicates(["_id", "_key"])
    return once.unionByName(repeated).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: one with the least id, null ids last. Of rows that also share it, one stays."""
    key = F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256))
    kept = exact_dedup.exact_dedup(docs).where("kept")
    chosen = kept.groupBy(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return _one_each(docs, key, chosen, F.lit(False))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: one with the least id, null ids last. Texts without words all stay."""
    text = near_dedup.normalised(F.col("text"))
    kept = near_dedup.near_duplicates(docs, with_keys=True).where("kept AND class_key IS NOT NULL")
    counted = kept.groupBy("class_key", F.col("doc_id").alias("id"), "key").agg(F.count(F.lit(1)).alias("rows"))
    first = counted.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "rows")).alias("c"))
    return _one_each(docs, near_dedup.text_key(text), first.select("c.id", "c.key", "c.rows"), text == "")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences at the mixture of the sources, with their ids."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

# The stages learn, sketch and tokenize, which SQL does not express; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
