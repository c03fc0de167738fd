"""Integer calendar keys, period literals and calendar tables.

Keys are integers: ``date_id`` yyyymmdd, ``week_id`` the yyyymmdd of the Friday that ends the
week, ``month_id`` yyyymm and ``year_id`` yyyy. A calendar table has one row per day with
``calendar_dt``, ``week_id`` and ``month_id``.
"""

from __future__ import annotations

import calendar as _calendar
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- keys of a date or timestamp column ------------------------------------------------------


def date_id(value: Column | str) -> Column:
    day = F.to_date(_col(value))
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def month_id(value: Column | str) -> Column:
    day = F.to_date(_col(value))
    return (F.year(day) * 100 + F.month(day)).cast("int")


def year_id(value: Column | str) -> Column:
    return F.year(F.to_date(_col(value))).cast("int")


def week_end(value: Column | str) -> Column:
    """The Friday on or after the date."""
    return F.next_day(F.date_sub(F.to_date(_col(value)), 1), "FRI")


def week_id(value: Column | str) -> Column:
    return date_id(week_end(value))


def stamp(value: Column | str) -> Column:
    """Timestamp as a yyyymmddhhmmss long."""
    return F.date_format(_col(value), "yyyyMMddHHmmss").cast("bigint")


# ---- period literals -------------------------------------------------------------------------


def period_start(value) -> dt.date | None:
    """First day of a 4, 6 or 8 digit period. Dates and epoch seconds are taken as their day."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return None
    if isinstance(value, float):
        return dt.datetime.fromtimestamp(value, dt.timezone.utc).date()
    if isinstance(value, int):
        digits = len(str(abs(value)))
        if digits == 4:
            return dt.date(value, 1, 1)
        if digits == 6:
            return dt.date(value // 100, value % 100, 1)
        if digits == 8:
            return dt.date(value // 10000, value // 100 % 100, value % 100)
        raise ValueError(f"period {value} needs 4, 6 or 8 digits")
    return None


def period_end(value) -> dt.date | None:
    """Last day of a 4, 6 or 8 digit period; any other accepted value is its own end."""
    start = period_start(value)
    if start is None or not isinstance(value, int):
        return start
    digits = len(str(value))
    if digits == 4:
        return start.replace(month=12, day=31)
    if digits == 6:
        return start.replace(day=_calendar.monthrange(start.year, start.month)[1])
    return start


def period_range(start, end) -> tuple[dt.date, dt.date]:
    """First and last day of ``start`` … ``end``; the two are swapped when given in reverse."""
    first, last = period_start(start), period_end(end)
    if first is None or last is None:
        raise ValueError(f"not a period: {start!r} … {end!r}")
    if last < first:
        first, last = period_start(end), period_end(start)
    return first, last


def day_key(day: dt.date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def month_key(day: dt.date) -> int:
    return day.year * 100 + day.month


def week_key(day: dt.date) -> int:
    return day_key(day + dt.timedelta(days=(4 - day.weekday()) % 7))


def period_start_col(value: Column | str) -> Column:
    """Column form of :func:`period_start` for integer periods."""
    p = _col(value)
    day = F.when(p < 10000, p * 10000 + 101).when(p < 1000000, p * 100 + 1).otherwise(p)
    return F.to_date(day.cast("string"), "yyyyMMdd")


def period_end_col(value: Column | str) -> Column:
    """Column form of :func:`period_end` for integer periods."""
    p = _col(value)
    day = F.to_date(F.when(p < 10000, p * 10000 + 1231).when(p < 1000000, p * 100 + 1).otherwise(p).cast("string"), "yyyyMMdd")
    return F.when(p.between(10000, 999999), F.last_day(day)).otherwise(day)


# ---- shifting --------------------------------------------------------------------------------


def shift(value: Column | str, months: int = 0, weeks: float = 0, days: int = 0) -> Column:
    """Move a date or timestamp by months (day clamped to the month end), else weeks, else days.

    Only the first non-zero argument counts.
    """
    moment = _col(value)
    if months:
        return moment + F.make_ym_interval(F.lit(0), F.lit(int(months)))
    step = round(weeks * 7) if weeks else int(days)
    return moment + F.expr(f"INTERVAL '{step}' DAY")


def shift_id(value: Column | str, days: int) -> Column:
    """A yyyymmdd value moved back by ``days``, as a yyyymmdd string."""
    day = F.to_date(_col(value).cast("string"), "yyyyMMdd")
    return F.date_format(F.date_sub(day, int(days)), "yyyyMMdd")


def week_back(value: Column | str, weeks: int) -> Column:
    """The week key ``weeks`` earlier, as a yyyymmdd string."""
    return shift_id(value, 7 * weeks)


def month_back(value: Column | str, months: int) -> Column:
    """The month key ``months`` earlier, as a yyyymm integer."""
    first = F.to_date(_col(value).cast("string"), "yyyyMM")
    return F.date_format(F.add_months(first, -int(months)), "yyyyMM").cast("int")


def months_between_shifted(later: Column | str, earlier: Column | str) -> Column:
    """Months between two dates after moving both one day on, with 31-day fractions."""
    a, b = F.date_add(F.to_date(_col(later)), 1), F.date_add(F.to_date(_col(earlier)), 1)
    whole = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    return whole + (F.dayofmonth(a) - F.dayofmonth(b)) / F.lit(31.0)


def today_eastern() -> Column:
    """Today's date on the US east coast."""
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), EASTERN))


def today_eastern_text() -> Column:
    return F.date_format(today_eastern(), "MM/dd/yyyy")


def days_since_friday(today: Column | str, weeks: int = 1) -> Column:
    """Days from :func:`last_friday` to ``today``."""
    day = F.to_date(_col(today))
    return F.date_diff(day, last_friday(day, weeks))


def last_friday(today: Column | str | None = None, weeks: int = 1) -> Column:
    """The last completed Friday; on a Friday it is the one before. Default today: US Eastern."""
    day = today_eastern() if today is None else F.to_date(_col(today))
    return F.date_sub(F.next_day(F.date_sub(day, 8), "FRI"), (weeks - 1) * 7)


# ---- calendar tables -------------------------------------------------------------------------


def with_keys(days: DataFrame, day: str = "calendar_dt") -> DataFrame:
    return days.select(F.col(day).alias("calendar_dt"), week_id(day).alias("week_id"), month_id(day).alias("month_id"))


def build_calendar(spark: SparkSession, start, end) -> DataFrame:
    """One row per day from ``start`` to ``end`` (period literals)."""
    first, last = period_range(start, end)
    days = spark.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("calendar_dt")
    )
    return with_keys(days)


def calendar_between(bounds: DataFrame, first: str = "first_dt", last: str = "last_dt") -> DataFrame:
    """One row per day between the two date columns of a one-row frame."""
    return with_keys(bounds.select(F.explode(F.sequence(F.col(first), F.col(last))).alias("calendar_dt")))


def _in_range(calendar: DataFrame, period: str, first: int, last: int) -> DataFrame:
    return calendar.where(F.col(period).between(int(first), int(last)))


def months(calendar: DataFrame, month_from: int, month_to: int) -> DataFrame:
    return periods(calendar, "month_id", month_from, month_to).orderBy("month_id")


def weeks(calendar: DataFrame, week_from: int, week_to: int) -> DataFrame:
    return periods(calendar, "week_id", week_from, week_to).orderBy("week_id")


def periods(calendar: DataFrame, period: str, first: int, last: int) -> DataFrame:
    """Distinct values of the period column in the range."""
    return _in_range(calendar, period, first, last).select(period).distinct()


def _bounds(calendar: DataFrame) -> list[Column]:
    day = F.date_format("calendar_dt", "yyyyMMdd")
    return [
        F.min("week_id").alias("begin_week_id"),
        F.max("week_id").alias("end_week_id"),
        F.min(day).alias("begin_svc_dt"),
        F.max(day).alias("end_svc_dt"),
        F.min("month_id").alias("begin_month_id"),
        F.max("month_id").alias("end_month_id"),
        F.countDistinct("week_id").alias("week_count"),
    ]


def period_bounds(calendar: DataFrame, month_from: int, month_to: int) -> DataFrame:
    """Week, date and month bounds of a month range, in one row."""
    return _in_range(calendar, "month_id", month_from, month_to).agg(*_bounds(calendar))


def month_week_bounds(calendar: DataFrame, month_from: int, month_to: int) -> DataFrame:
    """First and last week of every month in the range; at most one row per month."""
    return (
        _in_range(calendar, "month_id", month_from, month_to)
        .groupBy("month_id")
        .agg(F.min("week_id").alias("begin_week_id"), F.max("week_id").alias("end_week_id"))
    )


def refreshed_range(weeks_df: DataFrame, week: str = "week_id", flag: str = "data_refresh_ind") -> DataFrame:
    """First week, and last week whose refresh flag is set."""
    return weeks_df.agg(
        F.min(week).alias("min_week_id"), F.max(F.col(flag) * F.col(week)).alias("max_week_id")
    )


# Period kinds of :func:`cohort_periods`: unit to start from, step, months to the period's last day.
_PERIOD_KINDS = {
    "D": ("day", "1 day", None),
    "W": ("week", "7 days", None),
    "M": ("month", "1 month", 0),
    "Q": ("quarter", "3 months", 2),
    "Y": ("year", "12 months", 11),
}


def cohort_periods(
    spark: SparkSession, start, end, types: str = "M", lookback: int = 12, lookfward: int = 1, latestmth: int | None = None
) -> DataFrame:
    """Period ends from ``start`` to ``end``, numbered from 1, with look-back and look-forward months."""
    first, last = period_range(start, end)
    bounds = spark.range(1).select(F.lit(first).alias("first_dt"), F.lit(last).alias("last_dt"))
    return cohort_periods_between(bounds, types, lookback, lookfward, latestmth)


def cohort_periods_between(
    bounds: DataFrame, types: str = "M", lookback: int = 12, lookfward: int = 1, latestmth: int | None = None
) -> DataFrame:
    """:func:`cohort_periods` for the dates ``first_dt`` and ``last_dt`` of a one-row frame."""
    if types not in _PERIOD_KINDS:
        raise ValueError(f"period type {types!r} is not one of {sorted(_PERIOD_KINDS)}")
    unit, step, months_to_end = _PERIOD_KINDS[types]
    first, last = F.col("first_dt"), F.col("last_dt")
    begin = first if unit == "day" else F.to_date(F.date_trunc(unit, first))
    days = F.sequence(begin, last, F.expr(f"INTERVAL {step}"))
    if types == "W":
        days = F.transform(days, lambda d: F.date_add(d, 6))
    elif months_to_end is not None:
        days = F.transform(days, lambda d: F.last_day(F.add_months(d, months_to_end)))
    numbered = bounds.select(F.posexplode(F.filter(days, lambda d: d <= last)).alias("n", "day"))
    ahead = month_id(shift("day", months=lookfward))
    return numbered.select(
        (F.col("n") + 1).cast("int").alias("cohort"),
        F.lit(types).alias("type"),
        month_id("day").alias("start"),
        month_id(shift("day", months=1 - lookback)).alias("lookback"),
        (ahead if latestmth is None else F.least(ahead, F.lit(int(latestmth)))).alias("lookfward"),
    )
