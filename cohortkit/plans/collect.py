"""Loads of a query into a period-partitioned table, replacing the requested periods in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import calendar as cal
from cohortkit.functions.frames import match_column
from cohortkit.operators.extract import in_months
from cohortkit.sources import tables
from cohortkit.sources.readers import resolve
from cohortkit.sources.writers import beside, create_like, drop_partitions, insert_watched, reads_table, replace_partitions, swap_in

METHODS = ("INITIAL", "APPEND")


def _method(method: str) -> str:
    if str(method).upper() not in METHODS:
        raise ValueError(f"method {method!r} is not one of {METHODS}")
    return method.upper()


def period_filter(df: DataFrame, calendar: DataFrame, period: str, first: int, last: int) -> DataFrame:
    """Rows of the periods in the range that the calendar knows.

    Months also bound the week by the weeks of the row's own month when the frame has a week column.
    """
    if period.lower() == "month_id" and match_column(df, "week_id"):
        return in_months(df, calendar, first, last)
    known = F.broadcast(cal.periods(calendar, period.lower(), first, last).withColumnRenamed(period.lower(), "_known"))
    return df.where(F.col(period).between(int(first), int(last))).join(known, F.col(period) == F.col("_known"), "left_semi")


def collect_periods(
    spark: SparkSession,
    source: DataFrame | str,
    table: str,
    first: int,
    last: int,
    calendar: DataFrame,
    period: str = "month_id",
    method: str = "INITIAL",
    files: int | None = None,
) -> DataFrame:
    """Load the periods ``first`` … ``last`` of a query into ``table`` and return the table.

    INITIAL ends with these periods alone, APPEND keeps the other ones. All periods are one job; a requested
    period without rows ends empty. What was there stays until the rows are written, so a failing source
    loses nothing; a source that reads the table itself is an error. ``files`` bounds the files per period.
    """
    rows = resolve(spark, source)
    # One value per calendar period of the range: partition names, which the catalog takes one by one.
    requested = [r[0] for r in cal.periods(calendar, period.lower(), first, last).collect()]
    _load(rows, period_filter(rows, calendar, period, first, last), table, period, requested, method, files)
    return spark.table(table)


def _load(rows: DataFrame, cut: DataFrame, table: str, period: str, requested: list, method: str, files: int | None, spread: bool = True) -> None:
    """Replace the requested partitions; with INITIAL drop the other ones once the new rows are written.

    A table with other columns is replaced by a new one that is written beside it first.
    """
    spark = rows.sparkSession
    method = _method(method)
    if reads_table(rows, table):
        raise ValueError(f"the source reads {table}, which it would replace")
    if method == "APPEND" or not tables.exists(spark, table):
        replace_partitions(cut, table, period, requested, files, spread)
    elif sorted((n.lower(), t) for n, t in spark.table(table).dtypes) == sorted((n.lower(), t) for n, t in cut.dtypes):
        replace_partitions(cut, table, period, requested, files, spread)
        kept = {str(v) for v in requested}
        held = [row.partition.split("=", 1) for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
        drop_partitions(spark, table, match_column(spark.table(table), period), [v for _, v in held if v not in kept])
    else:
        made = beside(table)
        try:
            replace_partitions(cut, made, period, requested, files, spread)
        except Exception:
            tables.drop(spark, made)
            raise
        swap_in(spark, made, table)


def store_extract(claims: DataFrame, table: str, calendar: DataFrame, month_from: int, month_to: int, method: str = "INITIAL", files: int | None = None, by_month: bool = False) -> DataFrame:
    """Put extracted claims, already cut to the months, into a table by month, as ``collect_periods`` does.

    ``by_month`` tells that they were extracted so, and need not be shuffled for the write unless ``files`` is given.
    """
    requested = [r[0] for r in cal.periods(calendar, "month_id", month_from, month_to).collect()]
    _load(claims, claims, table, "month_id", requested, method, files, spread=files is not None or not by_month)
    return claims.sparkSession.table(table)


def add_partition(spark: SparkSession, source: DataFrame | str, table: str, partition: str, value, method: str = "INITIAL") -> DataFrame:
    """Put a query's rows into a table. The table is created when missing.

    INITIAL replaces the named partition, which ends empty without rows, and every other partition the rows
    belong to; running it again gives the same table, and a failing source loses nothing. APPEND adds rows.
    Statistics are renewed for the partitions that got rows, and only for them.
    """
    method = _method(method)
    rows = resolve(spark, source)
    if method == "INITIAL":
        filled = replace_partitions(rows, table, partition, [value])
    else:
        create_like(rows, table, partition)
        filled = insert_watched(rows, table, match_column(rows, partition))
    tables.analyze_partitions(spark, table, partition, filled)
    return spark.table(table)


def save_cohorts(df: DataFrame, table: str) -> DataFrame:
    """Save a panel or patient result by cohort, replacing the cohorts it holds, and renew their statistics."""
    tables.analyze_partitions(df.sparkSession, table, "cohort_id", replace_partitions(df, table, "cohort_id"))
    return df.sparkSession.table(table)
