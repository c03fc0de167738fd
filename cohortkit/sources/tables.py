"""Upkeep of catalog tables."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions.sketches import key_bits, with_maybe
from cohortkit.sources.writers import drop_partitions, insert_by_name, known_rows, partition_literal, spread_for_write

# Bytes of a well-sized file; one below half of it is small.
TARGET_BYTES = 128 * 2**20
# How the catalog names the partition of rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def database_exists(spark: SparkSession, database: str) -> bool:
    return spark.catalog.databaseExists(database)


def analyze(spark: SparkSession, table: str, partition: str | None = None, value=None) -> int:
    """Refresh, compute statistics for the table, one partition column or one partition, and count rows."""
    spark.catalog.refreshTable(table)
    part = ""
    if partition is not None:
        part = f" PARTITION ({partition})" if value is None else f" PARTITION ({partition} = {partition_literal(value)})"
    spark.sql(f"ANALYZE TABLE {table}{part} COMPUTE STATISTICS")
    # The table's own statistics hold the rows just counted; those of partitions do not add up there.
    rows = known_rows(spark, table) if partition is None else None
    return spark.table(table).count() if rows is None else rows


def analyze_partitions(spark: SparkSession, table: str, partition: str, values: Iterable) -> None:
    """Compute the statistics of some partitions; the others are not read."""
    spark.catalog.refreshTable(table)
    for value in values:
        spark.sql(f"ANALYZE TABLE {table} PARTITION ({partition} = {partition_literal(value)}) COMPUTE STATISTICS")


def partition_statistics(spark: SparkSession, table: str) -> DataFrame:
    """partition (its value as text), rows, bytes: what the catalog holds, without reading the table.

    Both are null for a partition that was never analyzed, and Spark keeps no rows for the one without a value.
    They are those of the last analysis, which the
    loads of this library run for the partitions they write.
    """
    found = []
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        name, value = row.partition.split("=", 1)
        spec = "NULL" if value == NO_VALUE else f"'{value}'"
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table} PARTITION ({name} = {spec})").collect()}
        numbers = re.match(r"(\d+) bytes(?:, (\d+) rows)?", told.get("Partition Statistics", ""))
        found.append((None if value == NO_VALUE else value, int(numbers[2]) if numbers and numbers[2] else None, int(numbers[1]) if numbers else None))
    return spark.createDataFrame(found, "partition string, rows bigint, bytes bigint")


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")


def truncate(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {table}")
    spark.catalog.refreshTable(table)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")


def drop_partition(spark: SparkSession, table: str, partition: str, value) -> None:
    drop_partitions(spark, table, partition, [value])


def preview(df: DataFrame, rows: int = 50) -> pd.DataFrame:
    return df.limit(rows).toPandas()


def compact(spark: SparkSession, table: str, partition: str | None = None, files_per_partition: int | None = None, target_bytes: int = TARGET_BYTES) -> list:
    """Rewrite what lies in many small files into evenly sized ones; returns the partitions rewritten.

    A partition is rewritten when two of its files are below half of ``target_bytes``, or with
    ``files_per_partition`` when it has more files; the files of all others stay as they are. Partitions are
    swapped in place by one job. A plain table goes through a copy, since a table cannot be overwritten while
    it is read; [None] stands for it.
    """
    place = [F.col(partition).alias("_at")] if partition else [F.lit(None).cast("string").alias("_at")]
    small = F.count_if(F.col("_size") < target_bytes / 2)
    sizes = spark.table(table).select(*place, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size")).distinct()
    # One row per partition that needs work, which the catalog knows one by one anyway.
    found = sizes.groupBy("_at").agg(F.count(F.lit(1)).alias("files"), small.alias("small"), F.sum("_size").alias("bytes"))
    needed = found.where((F.col("files") > files_per_partition) if files_per_partition else F.col("small") > 1).collect()
    if not needed:
        return []
    wanted = {r._at: files_per_partition or max(1, math.ceil(r.bytes / target_bytes)) for r in needed}
    rows = spark.table(table)
    if partition is None:
        _replace(spark, table, rows.repartition(wanted[None]))
        return [None]
    chosen = rows.where(_among(F.col(partition), list(wanted)))
    total, listed = 0, []
    for value, files in wanted.items():
        listed.append((value, files, total))
        total += files
    counts = spark.createDataFrame(listed, f"_at {dict(rows.dtypes)[partition]}, _files int, _first int")
    # One task per file.
    file = F.col("_first") + F.pmod(F.xxhash64(*rows.columns) + F.spark_partition_id(), F.col("_files"))
    spread = chosen.join(F.broadcast(counts), F.col(partition).eqNullSafe(F.col("_at"))).repartitionById(total, file.cast("int"))
    insert_by_name(spread.select(*rows.columns), table, overwrite=True)
    analyze_partitions(spark, table, partition, list(wanted))
    return list(wanted)


def dedupe(spark: SparkSession, table: str, partition: str | None = None) -> list:
    """Rewrite a table without repeated rows; returns the partitions rewritten, [None] for a plain table.

    Hashes of the rows tell first which ones may repeat: only those are shuffled and compared in full, all
    others pass through. A partition without a repeated row is left alone; so is a table without any. The
    partition column is part of the row, so partitions stay apart.
    """
    rows = spark.table(table)
    hashed = rows.select(*([F.col(partition).alias("_at")] if partition else [F.lit(None).cast("string").alias("_at")]), F.xxhash64(*rows.columns).alias("_h"))
    repeated = hashed.groupBy("_at", "_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # One value per partition.
    at = [r._at for r in repeated.select("_at").distinct().collect()]
    if not at:
        return []
    chosen = rows if partition is None else rows.where(_among(F.col(partition), at))
    flagged = with_maybe(chosen.withColumn("_h", F.xxhash64(*rows.columns)), key_bits(repeated, ["_h"]), ["_h"])
    once = flagged.where("NOT _maybe").select(*rows.columns)
    kept = once.unionByName(flagged.where("_maybe").select(*rows.columns).distinct())
    if partition is None:
        _replace(spark, table, spread_for_write(kept, None))
    else:
        insert_by_name(spread_for_write(kept, partition), table, overwrite=True)
        analyze_partitions(spark, table, partition, at)
    return at


def _among(column: Column, values: list) -> Column:
    known = [v for v in values if v is not None]
    found = column.isin(known) if known else F.lit(False)
    return found | column.isNull() if None in values else found


def _replace(spark: SparkSession, table: str, rows: DataFrame) -> None:
    copy = f"{table}_{uuid.uuid4().hex}"
    rows.write.format("parquet").saveAsTable(copy)
    insert_by_name(spark.table(copy), table, overwrite=True)
    drop(spark, copy)
    analyze(spark, table)


def partition_counts(spark: SparkSession, table: str, partition: str) -> DataFrame:
    return spark.table(table).groupBy(partition).agg(F.count(F.lit(1)).alias("record_count")).orderBy(partition)
