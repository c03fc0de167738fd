"""Removal of lines that many documents share, as keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import written

# Fixed values of the contract: characters of a key, documents that share it.
MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines(text: Column) -> Column:
    """The lines of a text; null as one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_mark(text: Column) -> Column:
    """Tells rows that share an id but not the text apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, keep): the keep bitmap of every document that loses lines.

    Line i stays when bit i % 64 of the word ``keep[i / 64]`` is set, or when there is no such word: the
    words end with the last one that drops a line. Line hashes are range-partitioned with falling document
    and position, so a very common line is spread over many ranges. In a range the rows of a hash are
    streamed in that order; where the document changes, a first occurrence begins. Each range hands on one
    summary per hash (documents, first and last document); a document that lies across a border of ranges
    is counted once.
    """
    found = docs.select(F.col(id_col).alias("id"), text_mark(F.col(text_col)).alias("mark"), F.posexplode(lines(F.col(text_col))).alias("pos", "line"))
    keys = found.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    # Two 64-bit hashes name a line; the second one is seeded by a constant.
    hashed = keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), F.col("key")).alias("g"), "id", "mark", "pos")
    falling = [F.col("id").desc_nulls_last(), F.col("mark"), F.col("pos")]
    ranged = hashed.repartitionByRange(F.col("h"), F.col("g"), *falling).sortWithinPartitions("h", "g", *falling)
    entries = written(ranged.withColumn("range", F.spark_partition_id()), "lines")

    here = ["range", "h", "g"]
    stream = Window.partitionBy(*here).orderBy(*falling)
    begins = (F.row_number().over(stream) == 1) | ~F.col("id").eqNullSafe(F.lag("id").over(stream))
    summaries = (
        entries.withColumn("begins", begins.cast("bigint"))
        .groupBy(*here)
        .agg(F.sum("begins").alias("docs"), F.max("id").alias("first"), F.min("id").alias("last"), F.max(F.col("id").isNull()).alias("ends_null"))
    )
    across = Window.partitionBy("h", "g").orderBy("range")
    of_hash = Window.partitionBy("h", "g")
    before = F.lag(F.struct("last", "ends_null")).over(across)
    same = F.when(F.col("first").isNull(), before["ends_null"]).otherwise(~before["ends_null"] & (before["last"] == F.col("first")))
    counted = summaries.withColumn("fresh", F.col("docs") - F.coalesce(same, F.lit(False)).cast("bigint"))
    shared = counted.select(*here, F.sum("fresh").over(of_hash).alias("docs"), F.max("first").over(of_hash).alias("stays")).where(F.col("docs") >= min_docs)
    lost = entries.join(shared.select(*here, "stays"), here).where(~F.col("id").eqNullSafe(F.col("stays")))

    words = lost.groupBy("id", "mark", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
    per_doc = words.groupBy("id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("word", "drop"))).alias("by_word"), F.max("word").alias("top"))
    keep = F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.bitwise_not(F.coalesce(F.try_element_at("by_word", w), F.lit(0).cast("bigint"))))
    return per_doc.select("id", "mark", keep.alias("keep"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_lines, n_dropped, keep (see ``keep_bitmaps``), text (what is left).

    A line whose key has ``min_chars`` characters and lies in ``min_docs`` documents stays only in the
    document with the largest id that holds it, there as often as it occurs; null ids come last. Rows that
    share an id are one document. A null or empty text is one empty line. An empty table gives no rows.
    Other columns are not read.
    """
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_mark", text_mark(F.col("_text")))
    found = rows.join(bitmaps, F.col("_doc").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark")), "left")
    kept = F.filter(lines(F.col("_text")), lambda line, i: F.coalesce(F.getbit(F.get("keep", F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1)
    whole = F.col("keep").isNull()
    split = found.select(
        F.col("_doc").alias(id_col),
        F.coalesce("keep", F.array().cast("array<bigint>")).alias("keep"),
        F.size(lines(F.col("_text"))).cast("bigint").alias("n_lines"),
        "_text",
        whole.alias("_whole"),
        F.when(~whole, kept).alias("_kept"),
    )
    return split.select(
        id_col,
        "n_lines",
        F.when(F.col("_whole"), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("bigint").alias("n_dropped"),
        "keep",
        F.when(F.col("_whole"), F.col("_text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
    )
