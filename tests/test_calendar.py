import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortkit.functions import calendar as cal

D = dt.date


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 6),), (D(2024, 1, 8),), (D(2024, 1, 11),)], "d date").orderBy("d")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def date(text):
    return F.to_date(F.lit(text))


def test_week_id(days):
    assert [r.w for r in days.select(cal.week_id("d").alias("w")).collect()] == [20240105, 20240112, 20240112, 20240112]


def test_last_friday(days):
    found = [r.w for r in days.select(cal.last_friday("d").alias("w")).collect()]
    assert found == [D(2023, 12, 29), D(2024, 1, 5), D(2024, 1, 5), D(2024, 1, 5)]
    earlier = [r.w for r in days.select(cal.last_friday("d", weeks=2).alias("w")).collect()]
    assert earlier == [d - dt.timedelta(7) for d in found]


def test_keys(spark):
    day = date("2024-02-09")
    got = spark.range(1).select(cal.date_id(day), cal.month_id(day), cal.year_id(day)).first()
    assert tuple(got) == (20240209, 202402, 2024)
    assert one(spark, cal.stamp(F.to_timestamp(F.lit("2024-02-09 03:04:05")))) == 20240209030405


@pytest.mark.parametrize(
    "literal,first,last",
    [
        (2024, D(2024, 1, 1), D(2024, 12, 31)),
        (202402, D(2024, 2, 1), D(2024, 2, 29)),
        (20240215, D(2024, 2, 15), D(2024, 2, 15)),
        (D(2024, 2, 3), D(2024, 2, 3), D(2024, 2, 3)),
        (dt.datetime(2024, 2, 3, 4), D(2024, 2, 3), D(2024, 2, 3)),
        (86400.0, D(1970, 1, 2), D(1970, 1, 2)),
        ("2024", None, None),
        (None, None, None),
    ],
)
def test_period_literal(literal, first, last):
    assert (cal.period_start(literal), cal.period_end(literal)) == (first, last)


def test_period_literal_needs_known_length():
    with pytest.raises(ValueError):
        cal.period_start(20241)


@pytest.mark.parametrize("literal", [2024, 202402, 20240215])
def test_period_columns_follow_literals(spark, literal):
    got = spark.range(1).select(cal.period_start_col(F.lit(literal)), cal.period_end_col(F.lit(literal))).first()
    assert tuple(got) == (cal.period_start(literal), cal.period_end(literal))


def test_period_range_swaps():
    assert cal.period_range(202403, 202401) == (D(2024, 1, 1), D(2024, 3, 31))


def test_shift(spark):
    assert one(spark, cal.shift(date("2024-01-31"), months=1)) == D(2024, 2, 29)
    assert one(spark, cal.shift(date("2024-03-31"), months=-1)) == D(2024, 2, 29)
    assert one(spark, cal.shift(date("2024-03-31"), months=-1, weeks=5, days=5)) == D(2024, 2, 29)
    assert one(spark, cal.shift(date("2024-03-31"), weeks=1, days=5)) == D(2024, 4, 7)
    assert one(spark, cal.shift(date("2024-03-31"))) == D(2024, 3, 31)
    assert one(spark, cal.shift(F.to_timestamp(F.lit("2024-01-31 10:00:00")), months=1)) == dt.datetime(2024, 2, 29, 10)


def test_months_between_shifted(spark):
    assert one(spark, cal.months_between_shifted(date("2023-02-28"), date("2023-01-30"))) == pytest.approx(1.032258064516129)
    assert one(spark, cal.months_between_shifted(date("2024-02-29"), date("2024-01-31"))) == 1.0


def test_back(spark):
    assert one(spark, cal.week_back(F.lit(20200110), 2)) == "20191227"
    assert one(spark, cal.month_back(F.lit(202003), 5)) == 201910
    assert one(spark, cal.shift_id(F.lit("20200301"), 1)) == "20200229"


def test_today_text(spark):
    got = spark.range(1).select(cal.today_eastern_text().alias("t"), cal.today_eastern().alias("d")).first()
    assert got.t == got.d.strftime("%m/%d/%Y")


def test_cohort_periods(spark):
    got = cal.cohort_periods(spark, 202401, 202403, lookback=12, lookfward=1, latestmth=202403)
    assert [tuple(r) for r in got.orderBy("cohort").collect()] == [
        (1, "M", 202401, 202302, 202402),
        (2, "M", 202402, 202303, 202403),
        (3, "M", 202403, 202304, 202403),
    ]
    free = cal.cohort_periods(spark, 202401, 202403, lookback=12, lookfward=1)
    assert [r.lookfward for r in free.orderBy("cohort").collect()] == [202402, 202403, 202404]


def test_cohort_periods_inside_a_month(spark):
    got = cal.cohort_periods(spark, 20240115, 20240310, lookback=1, lookfward=0)
    assert [(r.cohort, r.start, r.lookback, r.lookfward) for r in got.orderBy("cohort").collect()] == [
        (1, 202401, 202401, 202401),
        (2, 202402, 202402, 202402),
    ]


@pytest.mark.parametrize("kind,count", [("D", 366), ("W", 52), ("M", 12), ("Q", 4), ("Y", 1)])
def test_cohort_period_kinds(spark, kind, count):
    got = cal.cohort_periods(spark, 2024, 2024, types=kind)
    assert got.count() == count
    assert {r.cohort for r in got.collect()} == set(range(1, count + 1))
    with pytest.raises(ValueError):
        cal.cohort_periods(spark, 2024, 2024, types="X")


def test_bounds_and_lists(spark, year2000):
    got = cal.period_bounds(year2000, 200001, 200003).first().asDict()
    assert got == {
        "begin_week_id": 20000107,
        "end_week_id": 20000331,
        "begin_svc_dt": "20000101",
        "end_svc_dt": "20000331",
        "begin_month_id": 200001,
        "end_month_id": 200003,
        "week_count": 13,
    }
    assert [r[0] for r in cal.months(year2000, 199912, 200002).collect()] == [199912, 200001, 200002]
    assert [r[0] for r in cal.weeks(year2000, 20000101, 20000121).collect()] == [20000107, 20000114, 20000121]
    weeks = spark.createDataFrame([(20000107, 1), (20000114, 1), (20000121, 0)], "week_id int, data_refresh_ind int")
    assert tuple(cal.refreshed_range(weeks).first()) == (20000107, 20000114)


@settings(max_examples=25, deadline=None)
@given(st.dates(D(1990, 1, 1), D(2100, 12, 31)))
def test_week_key_is_the_next_friday(day):
    key = cal.week_key(day)
    friday = D(key // 10000, key // 100 % 100, key % 100)
    assert friday.weekday() == 4 and 0 <= (friday - day).days < 7
