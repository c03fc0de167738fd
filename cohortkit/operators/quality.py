"""Data-quality checks on period-partitioned tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import calendar as cal


def rows_per_period(df: DataFrame, period: str = "month_id") -> DataFrame:
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("record_count")).orderBy(period)


def month_coverage(df: DataFrame, period: str = "month_id") -> DataFrame:
    """Distinct months present, and months from the first to the last one."""
    last, first = (F.to_date(f(period).cast("string"), "yyyyMM") for f in (F.max, F.min))
    return df.agg(
        F.countDistinct(period).alias("number_of_months"),
        (F.months_between(last, first) + 1).cast("int").alias("number_of_datamonths"),
    )


def missing_periods(df: DataFrame, calendar: DataFrame, first: int, last: int, period: str = "month_id") -> DataFrame:
    """Calendar periods of the range that the table lacks."""
    present = df.where(F.col(period).between(int(first), int(last))).select(period).distinct()
    return cal.periods(calendar, period, first, last).join(present, period, "left_anti")


def assert_empty(df: DataFrame) -> None:
    if not df.isEmpty():
        raise AssertionError("a table that must be empty has rows")


def freshness(df: DataFrame, day: str, today: Column | None = None) -> DataFrame:
    """Newest date, the last completed Friday, and whether the two are equal."""
    newest = df.agg(F.to_date(F.max(day)).alias("max_dt"))
    return newest.withColumn("expected_dt", cal.last_friday(today)).withColumn("is_fresh", F.col("max_dt") == F.col("expected_dt"))


def assert_fresh(df: DataFrame, day: str, today: dt.date | None = None) -> None:
    found = freshness(df, day, None if today is None else F.lit(today)).first()
    if not found.is_fresh:
        raise AssertionError(f"newest date {found.max_dt} is not the last Friday {found.expected_dt}")
