"""Panel stability, stable patients and eligible patients."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import bitmaps
from cohortkit.functions import calendar as cal
from cohortkit.functions.frames import clean_code, select_existing


def _share(time_share) -> Decimal:
    """Percent of the weeks that a unit must be active in, clamped to [0, 100]."""
    if time_share is None:
        return Decimal(100)
    return Decimal(repr(min(max(float(time_share), 0.0), 100.0)))


def _week_list(calendar: DataFrame, first_week: int, last_week: int) -> list[int]:
    """The calendar's weeks of a requested range in order, read once: at most one number per week."""
    return sorted(r[0] for r in cal.periods(calendar, "week_id", first_week, last_week).collect())


def _words(count: int) -> list[str]:
    return [f"_w{j}" for j in range(count)]


def _override_words(overrides: DataFrame, weeks: list[int], unit: str) -> DataFrame:
    """``unit`` and the set of week places that each override covers, without a row per week."""
    listed = F.array(*[F.lit(w) for w in weeks]).cast("array<bigint>")
    start, end = F.col("start_week_id"), F.col("end_week_id")
    # An open interval covers nothing: a null bound leaves its place null.
    first = F.when(start.isNotNull(), F.size(F.filter(listed, lambda w: w < start)))
    last = F.when(end.isNotNull(), F.size(F.filter(listed, lambda w: w <= end)) - 1)
    words = bitmaps.words_for(len(weeks))
    return overrides.select(unit, *[w.alias(n) for n, w in zip(_words(words), bitmaps.interval_words(first, last, words))])


def expand_intervals(overrides: DataFrame, calendar: DataFrame, first_week: int, last_week: int, unit: str = "pharmacy_id") -> DataFrame:
    """One row per unit and calendar week covered by an override interval, inside the window.

    A unit's intervals are united as sets of weeks first, so overlapping and nested ones are expanded once.
    The weeks of the window are read when called.
    """
    weeks = _week_list(calendar, first_week, last_week)
    spans = _override_words(overrides, weeks, unit)
    names = spans.columns[1:]
    place = F.explode(bitmaps.members(names, len(weeks)))
    week_type = calendar.schema["week_id"].dataType
    listed = F.array(*[F.lit(w) for w in weeks] or [F.lit(None)]).cast(f"array<{week_type.simpleString()}>")
    united = spans.groupBy(unit).agg(*bitmaps.union(names)).select(unit, place.alias("_place"))
    return united.select(unit, F.get(listed, F.col("_place")).alias("week_id"))


def _active_weeks(weekly, calendar, overrides, first_week, last_week, unit) -> DataFrame:
    """Distinct (unit, week): observed activity in the window, plus override weeks."""
    active = weekly.where(F.col("week_id").between(first_week, last_week) & (F.col("pat_actn_ind") == 1)).select(unit, "week_id")
    if overrides is not None:
        active = active.unionByName(expand_intervals(overrides, calendar, first_week, last_week, unit))
    return active.distinct()


def _with_attributes(units: DataFrame, dimension: DataFrame | None, unit: str) -> DataFrame:
    if dimension is None:
        dimension = units.select(unit).limit(0).withColumns({"chnl_cd": F.lit(None).cast("string"), "store_typ_cd": F.lit(None).cast("string")})
    codes = dimension.select(unit, "chnl_cd", "store_typ_cd")
    return units.join(codes, unit, "left").select(
        unit,
        "elig_period_cnt",
        clean_code("chnl_cd").alias("chnl_cd"),
        clean_code("store_typ_cd").alias("store_typ_cd"),
        "stable_period_start",
        "stable_period_end",
        "cohort_id",
    )


def stable_units(
    weekly: DataFrame,
    calendar: DataFrame,
    start,
    end,
    cohort: int | str | None = None,
    overrides: DataFrame | None = None,
    dimension: DataFrame | None = None,
    time_share=100,
    unit: str = "pharmacy_id",
) -> DataFrame:
    """Units active in at least ``floor(weeks * time_share / 100)`` weeks of the window.

    ``weekly`` holds (unit, week_id, pat_actn_ind), ``overrides`` (unit, start_week_id, end_week_id) and
    ``dimension`` (unit, chnl_cd, store_typ_cd). ``start`` and ``end`` are period literals; the default
    cohort is the month of the first day.
    """
    first, last = cal.period_range(start, end)
    first_week, last_week = cal.week_key(first), cal.week_key(last)
    cohort_id = cal.month_key(first) if cohort is None else int(cohort)

    active = _active_weeks(weekly, calendar, overrides, first_week, last_week, unit)
    needed = calendar.where(F.col("week_id").between(first_week, last_week)).agg(
        F.floor(F.countDistinct("week_id") * F.lit(_share(time_share)) / 100).cast("bigint")
    )
    stable = (
        active.groupBy(unit)
        .agg(F.count("week_id").alias("elig_period_cnt"))
        .where(F.col("elig_period_cnt") >= needed.scalar())
        .withColumns(
            {
                "stable_period_start": F.lit(first),
                "stable_period_end": F.lit(last),
                "cohort_id": F.lit(cohort_id).cast("bigint"),
            }
        )
    )
    return _with_attributes(stable, dimension, unit)


def cohort_windows(cohorts: DataFrame) -> DataFrame:
    """First and last day and week of each cohort's window, from period ``lookback`` to ``start``."""
    begin, finish = cal.period_start_col("lookback"), cal.period_end_col("start")
    swapped = finish < begin
    # Each step goes through a one-element array, or Spark would copy the date arithmetic into every use.
    days = cohorts.select(
        F.col("cohort").cast("bigint").alias("cohort_id"),
        F.inline(
            F.array(
                F.struct(
                    F.when(swapped, cal.period_start_col("start")).otherwise(begin).alias("stable_period_start"),
                    F.when(swapped, cal.period_end_col("lookback")).otherwise(finish).alias("stable_period_end"),
                )
            )
        ),
    )
    weeks = F.struct(cal.week_id("stable_period_start").alias("_first_week"), cal.week_id("stable_period_end").alias("_last_week"))
    return days.select("*", F.inline(F.array(weeks)))


_WINDOW = ["cohort_id", "stable_period_start", "stable_period_end"]


class Windows:
    """The distinct windows of a cohort list and the weeks they span, read once: both bounded by the list."""

    def __init__(self, spark: SparkSession, cohorts: DataFrame | pd.DataFrame, calendar: DataFrame):
        if isinstance(cohorts, pd.DataFrame):
            cohorts = spark.createDataFrame(cohorts)
        if not isinstance(cohorts, DataFrame):
            raise TypeError("cohorts must be a Spark or pandas frame")
        self.spark = spark
        found = cohort_windows(cohorts).distinct()
        self.schema = found.schema
        rows = found.collect()
        whole = [r for r in rows if r._first_week is not None and r._last_week is not None]
        self.rows: list[Row] = sorted(whole, key=lambda r: (r._first_week, r._last_week, str(r.cohort_id)))
        self.weeks = _week_list(calendar, min(r._first_week for r in self.rows), max(r._last_week for r in self.rows)) if self.rows else []

    def places(self, row: Row) -> list[int]:
        """Places of a window's weeks in the list of weeks."""
        return [i for i, w in enumerate(self.weeks) if row._first_week <= w <= row._last_week]

    def in_range(self, weekly: DataFrame) -> DataFrame:
        """Rows of the weeks that some window needs; plain bounds, so a table partitioned by week is pruned."""
        if not self.weeks:
            return weekly.where(F.lit(False))
        return weekly.where(F.col("week_id").between(self.weeks[0], self.weeks[-1]))

    def by_week(self) -> DataFrame:
        """Local: each week with its place and the set of windows that hold it."""
        words = bitmaps.words_for(len(self.rows))
        held = [[n for n, r in enumerate(self.rows) if r._first_week <= w <= r._last_week] for w in self.weeks]
        rows = [(w, i, *bitmaps.literal_words(h, words)) for i, (w, h) in enumerate(zip(self.weeks, held))]
        names = ", ".join(f"_in{j} bigint" for j in range(words))
        return self.spark.createDataFrame(rows, f"_week int, _place int, {names}")

    def masks(self, time_share) -> DataFrame:
        """Local, one row with ``all``: each window with its set of weeks and the weeks it needs."""
        words = bitmaps.words_for(len(self.weeks))
        rows = []
        for r in self.rows:
            places = self.places(r)
            rows.append((r.cohort_id, r.stable_period_start, r.stable_period_end, int(len(places) * _share(time_share) // 100), bitmaps.literal_words(places, words)))
        given = self.spark.createDataFrame(rows, "cohort_id bigint, stable_period_start date, stable_period_end date, needed bigint, mask array<bigint>")
        return given.agg(F.collect_list(F.struct("*")).alias("all"))

    def numbered(self) -> DataFrame:
        """Local: the windows with their numbers."""
        rows = [(n, r.cohort_id, r.stable_period_start, r.stable_period_end) for n, r in enumerate(self.rows)]
        return self.spark.createDataFrame(rows, "_number int, cohort_id bigint, stable_period_start date, stable_period_end date")


def stable_units_bulk(
    weekly: DataFrame,
    calendar: DataFrame,
    cohorts: DataFrame | pd.DataFrame | Windows,
    overrides: DataFrame | None = None,
    dimension: DataFrame | None = None,
    time_share=100,
    unit: str = "pharmacy_id",
) -> DataFrame:
    """:func:`stable_units` for every row (cohort, start, lookback) of ``cohorts``, in one pass.

    ``cohorts`` may be a local frame. Each distinct window is judged by itself, also when several share a
    cohort. The weeks of a unit are one set of bits, united before the only shuffle, and a window counts what
    it has in common with them: no row is made per unit, week and window. The windows and their weeks are read
    when called. Weeks that the calendar lacks do not count.
    """
    windows = cohorts if isinstance(cohorts, Windows) else Windows(weekly.sparkSession, cohorts, calendar)
    words = bitmaps.words_for(len(windows.weeks))
    names = _words(words)
    active = windows.in_range(weekly).where(F.col("pat_actn_ind") == 1)
    # One local row per week of the range.
    placed = active.join(F.broadcast(windows.by_week().select("_week", "_place")), F.col("week_id") == F.col("_week"))
    sets = placed.select(unit, *[w.alias(n) for n, w in zip(names, bitmaps.member_words(F.col("_place"), words))])
    if overrides is not None:
        sets = sets.unionByName(_override_words(overrides, windows.weeks, unit))
    united = sets.groupBy(unit).agg(*bitmaps.union(names)).withColumns({"_weeks": F.array(*names), "_windows": windows.masks(time_share).scalar()})
    counted = F.transform(
        "_windows",
        lambda w: F.struct(*[w[c].alias(c) for c in _WINDOW], bitmaps.count_common(F.col("_weeks"), w["mask"]).cast("bigint").alias("elig_period_cnt"), w["needed"].alias("needed")),
    )
    enough = F.filter(counted, lambda w: (w["elig_period_cnt"] > 0) & (w["elig_period_cnt"] >= w["needed"]))
    stable = united.select(unit, F.explode(enough).alias("_s")).select(unit, *[f"_s.{c}" for c in _WINDOW], "_s.elig_period_cnt")
    return _with_attributes(stable, dimension, unit)


def stable_patients_bulk(
    patient_weeks: DataFrame, panel: DataFrame, calendar: DataFrame, cohorts: DataFrame | pd.DataFrame | Windows, unit: str = "pharmacy_id", patient: str = "patient_id"
) -> DataFrame:
    """For every window, the patients all of whose units in its weeks are in its panel, with their channels.

    ``patient_weeks`` holds (patient, unit, week_id), ``panel`` the rows of :func:`stable_units_bulk`. Sets of
    windows take the place of rows per window: those that list a unit, those in which a patient used it, and
    those in which some unit was not listed. They are united per patient and channel, then per patient. Rows
    without a patient are left out; a row without a unit makes its windows unstable.
    """
    windows = cohorts if isinstance(cohorts, Windows) else Windows(panel.sparkSession, cohorts, calendar)
    words = bitmaps.words_for(len(windows.rows))
    listed, used, missed = ([f"_{k}{j}" for j in range(words)] for k in ("of", "in", "miss"))
    same = F.lit(True)
    numbers = windows.numbered().toDF("_number", *[f"_{c}" for c in _WINDOW])
    for c in _WINDOW:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # One local row per window.
    members = panel.join(F.broadcast(numbers), same).select(F.col(unit).alias("_unit"), F.col("chnl_cd"), *[w.alias(n) for n, w in zip(listed, bitmaps.member_words(F.col("_number"), words))])
    per_channel = members.groupBy("_unit", "chnl_cd").agg(*bitmaps.union(listed))
    units = per_channel.groupBy("_unit").agg(F.collect_list(F.struct("chnl_cd", *listed)).alias("_channels"), *bitmaps.union(listed))

    seen = windows.in_range(patient_weeks).where(F.col(patient).isNotNull())
    placed = seen.join(F.broadcast(windows.by_week().drop("_place")), F.col("week_id") == F.col("_week")).join(units, F.col(unit) == F.col("_unit"), "left")
    lost = [F.col(u).bitwiseAND(F.bitwise_not(F.coalesce(o, F.lit(0).cast("bigint")))).alias(m) for u, o, m in zip(used, listed, missed)]
    rows = placed.select(patient, *used, *lost, F.explode_outer("_channels").alias("_c"))
    hits = [F.coalesce(F.col(u).bitwiseAND(F.col(f"_c.{o}")), F.lit(0).cast("bigint")).alias(u) for u, o in zip(used, listed)]
    by_channel = rows.select(patient, F.col("_c.chnl_cd").alias("chnl_cd"), *hits, *missed).groupBy(patient, "chnl_cd").agg(*bitmaps.union([*used, *missed]))
    judged = by_channel.groupBy(patient).agg(F.collect_list(F.struct("chnl_cd", F.array(*used).alias("of"))).alias("_channels"), *bitmaps.union([*used, *missed]))
    stable = judged.select(patient, "_channels", *[F.col(u).bitwiseAND(F.bitwise_not(m)).alias(u) for u, m in zip(used, missed)])
    found = stable.select(patient, "_channels", F.explode(bitmaps.members(used, len(windows.rows))).alias("_number"))
    here = F.filter("_channels", lambda c: c["chnl_cd"].isNotNull() & (F.getbit(F.get(c["of"], F.floor(F.col("_number") / bitmaps.WIDTH).cast("int")), F.pmod("_number", F.lit(bitmaps.WIDTH)).cast("int")) == 1))
    channels = F.array_sort(F.transform(here, lambda c: c["chnl_cd"]))
    dated = found.select(patient, "_number", channels.alias("cnls_cds")).join(F.broadcast(windows.numbered()), "_number")
    return dated.select("cohort_id", patient, "stable_period_start", "stable_period_end", "cnls_cds")


def stable_patients(patient_data: DataFrame, panel: DataFrame, unit: str = "pharmacy_id", patient: str = "patient_id", by_cohort: bool = False) -> DataFrame:
    """Patients all of whose units are in the panel, with the channels they use, one row per cohort and window.

    A row without a unit makes its patient unstable; rows without a patient are never removed. With
    ``by_cohort`` the patient data carries ``cohort_id`` and is judged against that cohort's panel rows.
    Otherwise such a column is ignored: a unit is in the panel when any cohort lists it, and a stable
    patient comes back for every cohort and window that lists one of its units.
    """
    keys = [unit, "cohort_id"] if by_cohort else [unit]
    people = [patient, "cohort_id"] if by_cohort else [patient]
    pairs = select_existing(patient_data, {patient, *keys}).distinct()
    members = panel.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.struct("cohort_id", "stable_period_start", "stable_period_end").alias("_of"), "chnl_cd"
    )
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    placed = pairs.join(members, match, "left").withColumn("_inside", F.col("_of").isNotNull())
    # First per window, then over the windows of a patient, by one shuffle on the patient's columns.
    per_window = (
        placed.withColumn("_nobody", F.when(F.col(patient).isNull(), F.col("_inside")))
        .groupBy(*people, "_nobody", "_of")
        .agg(F.min("_inside").alias("_inside"), F.array_sort(F.collect_set("chnl_cd")).alias("cnls_cds"))
    )
    judged = (
        per_window.groupBy(*people, "_nobody")
        .agg(F.min("_inside").alias("_stable"), F.collect_list(F.struct("_of", "cnls_cds")).alias("_windows"))
        .where(F.col("_stable") | F.col(patient).isNull())
        .select(patient, F.explode("_windows").alias("_w"))
    )
    of = F.col("_w._of")
    return judged.select(
        of["cohort_id"].alias("cohort_id"),
        patient,
        of["stable_period_start"].alias("stable_period_start"),
        of["stable_period_end"].alias("stable_period_end"),
        F.col("_w.cnls_cds").alias("cnls_cds"),
    )


def eligible_patients(
    patients: DataFrame,
    starts: DataFrame | None = None,
    activity: DataFrame | None = None,
    start=None,
    end=None,
    patient: str = "patient_id",
) -> DataFrame:
    """Patients first seen before ``start`` and active in the last three months up to ``end``.

    ``starts`` holds (patient, pat_strt_dt_rx), ``activity`` (patient, month_id). Each check runs when
    its bound is given.
    """
    first = cal.period_start(start)
    last = cal.period_end(end)
    if first is not None and last is not None:
        first, last = cal.period_range(start, end)
    result = patients
    if first is not None and starts is None or last is not None and activity is None:
        raise ValueError("start needs starts, and end needs activity")
    if first is not None:
        early = starts.where(F.col("pat_strt_dt_rx") < F.lit(first)).select(patient).distinct()
        result = result.join(early, patient, "left_semi")
    if last is not None:
        end_month = cal.month_key(last)
        begin_month = end_month - 2 if end_month % 100 > 2 else end_month - 90
        recent = activity.where(F.col("month_id").between(begin_month, end_month)).select(patient).distinct()
        result = result.join(recent, patient, "left_semi")
    return result.select(*patients.columns)
