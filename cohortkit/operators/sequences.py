"""Token-sequence features: lengths, vocabulary, padded index columns and vector matrix.

A sequence is one string with ``|`` between tokens. Spark rows have no order, so documents carry a
unique order column; it breaks ties between equally frequent tokens by first appearance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from cohortkit.functions.running import running_totals

# The reported length percentiles.
PERCENTILES = (75, 80, 90, 95, 98)

# Tasks over which the places of one token are spread, and copies of each vocabulary entry.
SPREAD = 8

# A vocabulary of at most so many words is sent to every task, so that no token has to move to meet it.
BROADCAST_WORDS = 100_000


def length_percentiles(texts: DataFrame, text: str = "text", percents: Sequence[float] = PERCENTILES, truncate: bool = False) -> DataFrame:
    """Length percentiles over all sequences, interpolated; ``truncate`` cuts them to whole numbers."""
    lengths = texts.select(F.size(F.split(text, r"\|")).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(*[F.lit(p / 100) for p in percents])
    found = lengths.agg(F.percentile("length", levels, F.col("n")).alias("found"))
    named = F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("pct"), F.col("found").alias("length"))
    value = F.col("pair.length")
    return found.select(F.explode(named).alias("pair")).select(
        F.col("pair.pct").alias("pct"), (value.cast("int") if truncate else value).alias("length")
    )


def _tokens(texts: DataFrame, order: str, text: str) -> DataFrame:
    if not isinstance(texts.schema[order].dataType, IntegralType | DecimalType):
        raise ValueError(f"order column {order!r} must hold whole numbers")
    parts = texts.select(F.col(order).alias("_doc"), F.posexplode(F.split(F.lower(text), r"\|")).alias("_pos", "token"))
    return parts.where(F.col("token") != "")


def _counts(tokens: DataFrame) -> DataFrame:
    # Document and position in one number, since a hash aggregate cannot hold the least of a pair.
    place = F.col("_doc").cast("decimal(38,0)") * F.lit(2**31) + F.col("_pos")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.min(place.cast("decimal(38,0)")).alias("_first"))


def build_vocab(texts: DataFrame, order: str, text: str = "text", slices: int | None = None) -> DataFrame:
    """Every token with its count and its index from 1, by falling count, then first appearance."""
    ones = _counts(_tokens(texts, order, text)).withColumn("index", F.lit(1).cast("bigint"))
    ranked = running_totals(ones, [("count", True), ("_first", False)], ["index"], slices=slices)
    return ranked.select("token", F.col("cum_index").alias("index"), "count")


def top_vocab(texts: DataFrame, order: str, max_words: int, text: str = "text") -> DataFrame:
    """The vocabulary entries with an index below ``max_words``."""
    return build_vocab(texts, order, text).where(F.col("index") < max_words)


def encode(texts: DataFrame, order: str, max_words: int | None, max_length: int, text: str = "text", vocab: DataFrame | None = None) -> DataFrame:
    """Columns ``seq_0`` … of the last ``max_length`` known tokens of each document, zeros at the end.

    Tokens whose index reaches ``max_words`` are left out before the cut; None keeps all. The order column
    must be unique, as it names the document; two documents that share a value are an error.
    """
    if vocab is None:
        vocab = build_vocab(texts, order, text) if max_words is None else top_vocab(texts, order, max_words, text)
    known = vocab.select("token", F.col("index").cast("int").alias("index"))
    if max_words is not None:
        known = known.where(F.col("index") < max_words)
    # Position 0 holds a mark that keeps documents without known tokens; unknown tokens go at once.
    marked = F.concat(F.array(F.lit("")), F.split(F.lower(text), r"\|"))
    parts = texts.select(order, F.posexplode(F.coalesce(marked, F.array(F.lit("")))).alias("_pos", "token"))
    placed = F.when(F.col("index").isNotNull(), F.shiftleft(F.col("_pos").cast("bigint"), 32) + F.col("index"))
    if max_words is not None and max_words <= BROADCAST_WORDS:
        joined = parts.join(F.broadcast(known), "token", "left")
    else:
        spread = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        joined = parts.withColumn("_part", F.pmod(F.xxhash64(order, "_pos"), F.lit(SPREAD)).cast("int")).join(spread, ["token", "_part"], "left")
    # The tokens of one document come from one row, so the regrouped array is no larger than that row.
    found = (
        joined
        .where((F.col("_pos") == 0) | F.col("index").isNotNull())
        .groupBy(order)
        .agg(F.sort_array(F.collect_list(placed)).alias("_seq"), F.count_if(F.col("_pos") == 0).alias("_docs"))
        .withColumn("_seq", F.when(F.col("_docs") > 1, F.raise_error(F.lit("the order column is not unique"))).otherwise(F.col("_seq")))
    )
    tail = F.slice("_seq", F.greatest(F.size("_seq") - max_length + 1, F.lit(1)), F.lit(max_length))
    indexes = F.transform(tail, lambda v: v.bitwiseAND(F.lit(2**32 - 1)).cast("int"))
    padded = found.select(order, F.concat(indexes, F.array_repeat(F.lit(0), max_length)).alias("_padded"))
    return padded.select(order, *[F.col("_padded")[i].alias(f"seq_{i}") for i in range(max_length)])


def load_vectors(spark: SparkSession, path: str, words: DataFrame | None = None) -> DataFrame:
    """Word vectors from text lines ``word v1 v2 …``; of repeated words the last line wins.

    With ``words`` (a column ``word``) all other lines go before anything is shuffled but the words themselves.
    """
    lines = spark.read.text(path).select(
        F.split(F.btrim("value", F.lit(" \t\r")), " ").alias("parts"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("place"),
    )
    lines = lines.withColumn("word", F.col("parts")[0])
    if words is not None:
        lines = lines.join(words.select("word").distinct(), "word", "left_semi")
    vector = F.transform(F.slice("parts", F.lit(2), F.size("parts") - 1), lambda v: v.cast("float"))
    return lines.groupBy("word").agg(F.max_by(vector, "place").alias("vector"))


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, max_features: int, dim: int = 300) -> DataFrame:
    """One row per index 0 … ``max_features`` - 1 with the vector of its word, zeros when there is none.

    The vectors are cut to the wanted words before they are joined; one of another length is an error.
    """
    spark = vocab.sparkSession
    words = vocab.where(F.col("index") < max_features).select("index", F.col("token").alias("word"))
    wanted = vectors.select("word", "vector").join(words.select("word").distinct(), "word", "left_semi")
    found = F.when(F.size("vector") != dim, F.raise_error(F.concat(F.lit(f"not {dim} numbers for "), F.col("word")))).otherwise(F.col("vector"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (
        spark.range(max_features)
        .withColumnRenamed("id", "index")
        .join(words, "index", "left")
        .join(wanted.select("word", found.alias("vector")), "word", "left")
        .select("index", F.coalesce("vector", zeros).alias("vector"))
    )
