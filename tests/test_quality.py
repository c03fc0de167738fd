import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import quality


def months(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "month_id int")


def test_missing_periods(spark, year2000, rows):
    table = months(spark, 200002, 200003, 200003, 200004)
    assert rows(quality.missing_periods(table, year2000, 200001, 200003)) == [(200001,)]
    assert rows(quality.missing_periods(table, year2000, 200002, 200004)) == []
    present = {r.month_id for r in table.collect()}
    missing = {r.month_id for r in quality.missing_periods(table, year2000, 200001, 200012).collect()}
    assert present | missing == set(range(200001, 200013)) and not present & missing


def test_coverage(spark, rows):
    table = months(spark, 202001, 202003, 202003, 202012)
    assert rows(quality.month_coverage(table)) == [(3, 12)]
    assert [tuple(r) for r in quality.rows_per_period(table).collect()] == [(202001, 1), (202003, 2), (202012, 1)]


def test_assert_empty(spark):
    quality.assert_empty(months(spark))
    with pytest.raises(AssertionError):
        quality.assert_empty(months(spark, 1))


def test_freshness(spark):
    data = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 5),)], "d date")
    quality.assert_fresh(data, "d", dt.date(2024, 1, 8))
    with pytest.raises(AssertionError):
        quality.assert_fresh(data, "d", dt.date(2024, 1, 5))
    assert quality.freshness(data, "d", F.lit(dt.date(2024, 1, 12))).first().is_fresh
