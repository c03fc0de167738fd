"""Sinks: catalog tables, partition replacement, JDBC targets and delimited text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortkit.functions.frames import lower_columns, match_column, upper_columns
from cohortkit.sources.readers import jdbc_options, read_jdbc, resolve

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def spread_for_write(df: DataFrame, partition: str | None, files: int | None = None) -> DataFrame:
    """Lay rows out for writing.

    Without ``files`` Spark sizes the tasks: small partitions share one, a large partition is split.
    With ``files`` each table partition gets at most that many files, filled by content and input slice,
    so copies of one row do not meet in one task.
    """
    if files is None:
        return df.hint("rebalance", *([partition] if partition else []))
    if partition is None:
        return df.repartition(files)
    salt = F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.lit(files))
    return df.withColumn("_salt", salt).repartition(partition, "_salt").drop("_salt")


def insert_by_name(df: DataFrame, table: str, overwrite: bool = False) -> None:
    """Insert with columns put in the table's order. Overwriting touches only the partitions that get rows.

    ``insertInto`` does not heed the mode as an option of the write, so the session's setting is changed
    meanwhile.
    """
    spark = df.sparkSession
    target = spark.table(table)
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        df.select(*target.columns).write.insertInto(table, overwrite=overwrite)
    finally:
        spark.conf.set(OVERWRITE_MODE, before)
    spark.catalog.refreshTable(table)


def _partition_of(df: DataFrame, partition: str) -> str:
    """The frame's partition column, in any letter case."""
    found = match_column(df, partition)
    if found is None:
        raise ValueError(f"no column {partition!r} in {df.columns}")
    return found


def create_like(df: DataFrame, table: str, partition: str | None = None, fmt: str = "parquet") -> None:
    """An empty table with the frame's columns, the partition column last. Kept when it exists.

    Only the frame's schema is used; its query is not planned.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        return
    own = None if partition is None else _partition_of(df, partition)
    fields = sorted(df.schema.fields, key=lambda f: f.name == own)
    writer = spark.createDataFrame([], StructType(fields)).write.format(fmt)
    (writer.partitionBy(own) if own else writer).saveAsTable(table)


def reads_table(df: DataFrame, table: str) -> bool:
    """Whether the frame's query reads a catalog table."""
    spark = df.sparkSession
    wanted = table if "." in table else f"{spark.catalog.currentDatabase()}.{table}"
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("LogicalRelation") or leaf.getClass().getSimpleName() == "LogicalRelation":
            known = leaf.catalogTable()
            if known.isDefined():
                name = known.get().identifier()
                parts = [name.database().get() if name.database().isDefined() else spark.catalog.currentDatabase(), name.table()]
                if ".".join(parts).lower() == wanted.lower():
                    return True
    return False


def swap_in(spark: SparkSession, made: str, table: str) -> None:
    """Put a finished table in the place of another one.

    The old one is only renamed until the new one has its name, and goes last; if the change of names fails it
    gets its own back.
    """
    aside = beside(table) if spark.catalog.tableExists(table) else None
    if aside:
        _rename(spark, table, aside)
    try:
        _rename(spark, made, table)
    except Exception:
        if aside and not spark.catalog.tableExists(table):
            _rename(spark, aside, table)
        raise
    if aside:
        spark.sql(f"DROP TABLE IF EXISTS {aside} PURGE")


def _rename(spark: SparkSession, old: str, table: str) -> None:
    """Not every catalog moves the partitions with a renamed table, so their locations are set again."""
    spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    if "# Partition Information" in told:
        for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
            spec = ", ".join("{} = '{}'".format(*part.split("=", 1)) for part in row.partition.split("/"))
            spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION '{told['Location']}/{row.partition}'")
    spark.catalog.refreshTable(table)


def beside(table: str) -> str:
    """A fresh name in the table's database."""
    return f"{table}_{uuid.uuid4().hex}"


def save_table(
    source: DataFrame | str,
    table: str,
    partition: str | None = None,
    mode: str = "append",
    fmt: str = "parquet",
    upper: bool = False,
    files: int | None = None,
    cache: bool = False,
    analyze: bool = False,
    spark: SparkSession | None = None,
) -> int:
    """Create, append to or overwrite a table, and return how many rows were written.

    ``source`` is a frame, or with ``spark`` a query or a table name. The partition column is found in any
    letter case and ignored when the frame lacks it. ``upper`` upper-cases the columns; ``files`` bounds the
    files per partition. The rows are counted while they are written, so neither the frame nor the table is read
    again; with or without ``cache``, which is kept for callers. The count of a table that was appended to is
    that of its statistics (``tables.analyze``).
    """
    df = source if isinstance(source, DataFrame) else resolve(spark, source)
    spark = df.sparkSession
    out = upper_columns(df) if upper else df
    part = match_column(out, partition)
    seen = Observation()
    watched = out.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = spread_for_write(watched, part, files).write.mode(mode).format(fmt)
    (writer.partitionBy(part) if part else writer).saveAsTable(table)
    spark.catalog.refreshTable(table)
    if analyze:
        spark.sql(f"ANALYZE TABLE {table}{f' PARTITION ({part})' if part else ''} COMPUTE STATISTICS")
    return _observed(seen, "rows", out) or 0


def known_rows(spark: SparkSession, table: str) -> int | None:
    """Rows of the table by its catalog statistics; None without them. Any write drops them."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    found = re.search(r"(\d+) rows", told.get("Statistics", ""))
    return int(found[1]) if found else None


def run_insert(spark: SparkSession, table: str, statement: str) -> int:
    """Run an INSERT statement, refresh and analyze its table, and return the row count, which the statistics hold."""
    spark.sql(statement)
    spark.catalog.refreshTable(table)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    rows = known_rows(spark, table)
    return spark.table(table).count() if rows is None else rows


def replace_partitions(
    df: DataFrame, table: str, partition: str, requested: Iterable | None = None, files: int | None = None, spread: bool = True
) -> list:
    """Write ``df`` so that its partitions, and the requested ones, hold exactly its rows.

    Other partitions stay as they are. A requested partition without new rows ends empty. The table is
    created when missing. Running it twice gives the same table: new files replace a partition only once
    the job has succeeded, and the stale partitions are dropped after that. Returns the partitions written to.
    Without ``spread`` the rows are written as they are dealt.
    """
    spark = df.sparkSession
    create_like(df, table, partition)
    own = _partition_of(df, partition)
    filled = insert_watched(df, table, own, files, overwrite=True, spread=spread)
    if requested is not None:
        known = {str(v) for v in filled}
        drop_partitions(spark, table, partition, [v for v in requested if str(v) not in known])
    return filled


def insert_watched(df: DataFrame, table: str, partition: str, files: int | None = None, overwrite: bool = False, spread: bool = True) -> list:
    """Insert and return the partitions that got rows."""
    written = Observation()
    # The set holds one value per written partition, which the catalog has to know anyway.
    watched = df.observe(written, F.collect_set(partition).alias("values"), F.count_if(F.col(partition).isNull()).alias("nulls"))
    insert_by_name(spread_for_write(watched, partition, files) if spread else watched, table, overwrite)
    return [*(_observed(written, "values", df) or ()), *([None] if _observed(written, "nulls", df) else [])]


def drop_partitions(spark: SparkSession, table: str, partition: str, values: Iterable) -> None:
    """Drop partitions by one statement; those that do not exist are passed over."""
    specs = [f"PARTITION ({partition} = {partition_literal(v)})" for v in values]
    if specs:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(specs)}")
    spark.catalog.refreshTable(table)


def partition_literal(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else str(value)


def _observed(written: Observation, name: str, df: DataFrame):
    """What a finished write saw, or None.

    Spark leaves the observation out of a plan it knows to be empty. Only a frame that is found to have
    no rows may then count as having written nothing.
    """
    try:
        return written.get[name]
    except Py4JJavaError:
        if not df.isEmpty():
            raise
        return None


def write_jdbc(source: DataFrame | str, url: str, dbtable: str, mode: str = "overwrite", upper: bool | None = None, spark: SparkSession | None = None, **options) -> None:
    """Write a frame, or with ``spark`` a query or a table name, to a JDBC table.

    Overwriting drops and recreates it, with upper-cased columns by default.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode {mode!r} is not overwrite or append")
    df = source if isinstance(source, DataFrame) else resolve(spark, source)
    out = upper_columns(df) if (mode == "overwrite" if upper is None else upper) else df
    out.write.format("jdbc").mode(mode).options(**jdbc_options(url, dbtable, **options)).save()


def copy_target(spark: SparkSession, source: str, target: str | None, default_database: str) -> str:
    """Name of a copy: ``database.table``, or the source's table name in a database, or a table name in the default."""
    name = source.split(".")[-1].strip().lower()
    if target is None:
        return f"{default_database}.{name}"
    parts = [p.strip().lower() for p in target.split(".")]
    if len(parts) > 2:
        raise ValueError(f"target {target!r} is not database.table")
    if len(parts) == 2:
        return ".".join(parts)
    if spark.catalog.databaseExists(parts[0]):
        return f"{parts[0]}.{name}"
    return f"{default_database}.{parts[0]}"


def copy_table(
    spark: SparkSession,
    url: str,
    source: str,
    target: str | None = None,
    partition: str | None = None,
    fmt: str = "parquet",
    default_database: str = "default",
    **options,
) -> str:
    """Replace a catalog table by the content of a JDBC table, with lower-cased columns; returns its name.

    The old table stays until the new one is written.
    """
    table = copy_target(spark, source, target, default_database)
    rows = read_jdbc(spark, url, source, **options)
    made = beside(table)
    save_table(rows, made, partition, mode="overwrite", fmt=fmt)
    swap_in(spark, made, table)
    part = match_column(rows, partition)
    spark.sql(f"ANALYZE TABLE {table}{f' PARTITION ({part})' if part else ''} COMPUTE STATISTICS")
    return table


def write_csv(source: DataFrame | str, path: str, sep: str = ",", compression: str | None = None, spark: SparkSession | None = None) -> None:
    """Export as delimited text files with a header and lower-cased columns, one file per task."""
    df = source if isinstance(source, DataFrame) else resolve(spark, source)
    writer = lower_columns(df).write.mode("overwrite").options(header=True, sep=sep)
    (writer.option("compression", compression) if compression else writer).csv(path)
