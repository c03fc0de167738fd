"""Registered queries: every operator over the star tables, next to the SQL that must give the same rows.

Dates leave as text, period keys as integers, fractions rounded to six places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import calendar as cal
from cohortkit.functions import frames
from cohortkit.operators import chunks, correlation, extract, metrics, panel, quality, search, sequences, vectors
from cohortkit.plans import bindings as b
from cohortkit.plans import collect
from cohortkit.plans.bindings import ORDERED, SHIP, sql_date_id, sql_month, sql_week, with_roles
from cohortkit.session import scratch_path
from cohortkit.sources import readers, tables, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FIRST_MONTH, LAST_MONTH = 199501, 200112
FIRST_WEEK, LAST_WEEK = 19950106, 20020104
UNIT_SHARE, PATIENT_SHARE = 60, 58
MAX_WORDS, MAX_LENGTH, MAX_FEATURES, VECTOR_DIM = 200, 16, 500, 64


def register(name: str, sql: str):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        ORACLE[name] = sql
        return query

    return add


WORK = "cohortkit_work"
_made: dict[tuple[str, str], str] = {}


def work_table(spark: SparkSession, key: str) -> str:
    """A fresh table name for a write-and-read-back query; the key's former table is dropped."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {WORK}")
    session = (spark.sparkContext.applicationId, key)
    if session in _made:
        tables.drop(spark, _made[session])
    _made[session] = f"{WORK}.{key}_{uuid.uuid4().hex}"
    return _made[session]


# ---- calendar ----------------------------------------------------------------------------------


@register(
    "cal_keys",
    f"""SELECT {sql_date_id(SHIP)} AS date_id, {sql_week(SHIP)} AS week_id, {sql_month(SHIP)} AS month_id,
    CAST(year(l_shipdate) AS INT) AS year_id, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def cal_keys(spark, d):
    day = F.col("l_shipdate")
    keys = [cal.date_id(day).alias("date_id"), cal.week_id(day).alias("week_id"), cal.month_id(day).alias("month_id"), cal.year_id(day).alias("year_id")]
    return b.table(spark, d, "lineitem").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@register(
    "cal_period_bounds",
    with_roles("calendar")
    + f"""SELECT min(week_id) AS begin_week_id, max(week_id) AS end_week_id, strftime(min(calendar_dt), '%Y%m%d') AS begin_svc_dt,
    strftime(max(calendar_dt), '%Y%m%d') AS end_svc_dt, min(month_id) AS begin_month_id, max(month_id) AS end_month_id,
    count(DISTINCT week_id) AS week_count FROM calendar WHERE month_id BETWEEN {FIRST_MONTH} AND {LAST_MONTH}""",
)
def cal_period_bounds(spark, d):
    return cal.period_bounds(b.calendar(spark, d), FIRST_MONTH, LAST_MONTH)


@register("cal_months", with_roles("calendar") + f"SELECT DISTINCT month_id FROM calendar WHERE month_id BETWEEN {FIRST_MONTH} AND {LAST_MONTH}")
def cal_months(spark, d):
    return cal.months(b.calendar(spark, d), FIRST_MONTH, LAST_MONTH)


@register("cal_weeks", with_roles("calendar") + f"SELECT DISTINCT week_id FROM calendar WHERE week_id BETWEEN {FIRST_WEEK} AND {LAST_WEEK}")
def cal_weeks(spark, d):
    return cal.weeks(b.calendar(spark, d), FIRST_WEEK, LAST_WEEK)


@register(
    "cal_back",
    f"""SELECT DISTINCT {sql_date_id(ORDERED)} AS date_id, strftime(strptime(CAST({sql_week(ORDERED)} AS VARCHAR), '%Y%m%d') - INTERVAL 14 DAY, '%Y%m%d') AS week_back,
    CAST(strftime(date_trunc('month', {ORDERED}) - INTERVAL 5 MONTH, '%Y%m') AS INT) AS month_back,
    strftime({ORDERED} - INTERVAL 10 DAY, '%Y%m%d') AS days_back FROM orders""",
)
def cal_back(spark, d):
    day = F.col("o_orderdate")
    return (
        b.table(spark, d, "orders")
        .select(cal.date_id(day).alias("date_id"), cal.week_id(day).alias("week_id"), cal.month_id(day).alias("month_id"))
        .distinct()
        .select(
            "date_id",
            cal.week_back("week_id", 2).alias("week_back"),
            cal.month_back("month_id", 5).alias("month_back"),
            cal.shift_id("date_id", 10).alias("days_back"),
        )
    )


@register(
    "cal_shift",
    f"""SELECT DISTINCT {sql_date_id(ORDERED)} AS date_id, {sql_date_id(f'({ORDERED} + INTERVAL 1 MONTH)')} AS month_on,
    {sql_date_id(f'({ORDERED} - INTERVAL 13 MONTH)')} AS months_off, {sql_date_id(f'({ORDERED} + INTERVAL 14 DAY)')} AS weeks_on,
    {sql_date_id(f'({ORDERED} - INTERVAL 3 DAY)')} AS days_off FROM orders""",
)
def cal_shift(spark, d):
    days = b.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(
        cal.date_id("day").alias("date_id"),
        cal.date_id(cal.shift("day", months=1)).alias("month_on"),
        cal.date_id(cal.shift("day", months=-13)).alias("months_off"),
        cal.date_id(cal.shift("day", weeks=2)).alias("weeks_on"),
        cal.date_id(cal.shift("day", days=-3)).alias("days_off"),
    )


def _sql_period(kind: str, first: str, last: str) -> str:
    return f"SELECT DISTINCT {kind} AS period, {sql_date_id(first)} AS first_id, {sql_date_id(last)} AS last_id FROM orders"


@register(
    "cal_period_literals",
    " UNION ALL ".join(
        [
            _sql_period("CAST(year(o_orderdate) AS INT)", f"date_trunc('year', {ORDERED})", f"make_date(year({ORDERED}), 12, 31)"),
            _sql_period(sql_month(ORDERED), f"date_trunc('month', {ORDERED})", f"last_day({ORDERED})"),
            _sql_period(sql_date_id(ORDERED), ORDERED, ORDERED),
        ]
    ),
)
def cal_period_literals(spark, d):
    day = F.col("o_orderdate")
    literals = F.array(cal.year_id(day), cal.month_id(day), cal.date_id(day))
    periods = b.table(spark, d, "orders").select(F.explode(literals).alias("period")).distinct()
    return periods.select(
        "period", cal.date_id(cal.period_start_col("period")).alias("first_id"), cal.date_id(cal.period_end_col("period")).alias("last_id")
    )


_TS = "CAST(ts AS DATE)"


@register(
    "cal_last_friday",
    f"""SELECT day_id, n, {sql_date_id("(day - days)")} AS last_friday, {sql_date_id("(day - days - 14)")} AS third_friday, CAST(days AS INT) AS days
    FROM (SELECT {_TS} AS day, {sql_date_id(_TS)} AS day_id, CAST((isodow({_TS}) + 1) % 7 + 1 AS INT) AS days, count(*) AS n FROM events GROUP BY 1, 2, 3)""",
)
def cal_last_friday(spark, d):
    days = b.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.select(
        cal.date_id("day").alias("day_id"),
        "n",
        cal.date_id(cal.last_friday("day")).alias("last_friday"),
        cal.date_id(cal.last_friday("day", weeks=3)).alias("third_friday"),
        cal.days_since_friday("day").alias("days"),
    )


@register(
    "cal_months_between",
    f"""SELECT DISTINCT {sql_date_id(SHIP)} AS later, {sql_date_id(ORDERED)} AS earlier,
    round((year({SHIP} + 1) - year({ORDERED} + 1)) * 12 + month({SHIP} + 1) - month({ORDERED} + 1) + (day({SHIP} + 1) - day({ORDERED} + 1)) / 31.0, 6)::DOUBLE AS months
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def cal_months_between(spark, d):
    orders = b.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("earlier"))
    lines = b.table(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("later"))
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("later", "earlier").distinct()
    return pairs.select(
        cal.date_id("later").alias("later"),
        cal.date_id("earlier").alias("earlier"),
        F.round(cal.months_between_shifted("later", "earlier"), 6).alias("months"),
    )


def _sql_cohorts(kind: str, ends: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY day) AS INT) AS cohort, '{kind}' AS type, {sql_month('day')} AS start,
    {sql_month("(day - INTERVAL 11 MONTH)")} AS lookback, least({sql_month("(day + INTERVAL 1 MONTH)")}, 200109) AS lookfward FROM ({ends})"""


_MONTH_ENDS = "SELECT DISTINCT last_day(calendar_dt) AS day FROM calendar"
_QUARTER_ENDS = "SELECT DISTINCT last_day(calendar_dt) AS day FROM calendar WHERE month(calendar_dt) IN (3, 6, 9, 12)"


@register("cal_cohort_periods", with_roles("calendar") + _sql_cohorts("M", _MONTH_ENDS) + " UNION ALL " + _sql_cohorts("Q", _QUARTER_ENDS))
def cal_cohort_periods(spark, d):
    bounds = b.date_bounds(spark, d)
    kinds = [cal.cohort_periods_between(bounds, t, lookback=12, lookfward=1, latestmth=200109) for t in ("M", "Q")]
    return kinds[0].unionByName(kinds[1])


@register("cal_stamp", "SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS stamp FROM events")
def cal_stamp(spark, d):
    return b.table(spark, d, "events").select("event_id", cal.stamp("ts").alias("stamp"))


# ---- panel -------------------------------------------------------------------------------------

_OVERRIDE_WEEKS = f"""SELECT pharmacy_id, week_id FROM overrides JOIN (SELECT DISTINCT week_id FROM calendar WHERE week_id BETWEEN {FIRST_WEEK} AND {LAST_WEEK})
    ON week_id BETWEEN start_week_id AND end_week_id"""


@register("panel_overrides", with_roles("calendar", "overrides") + _OVERRIDE_WEEKS)
def panel_overrides(spark, d):
    return panel.expand_intervals(b.overrides(spark, d), b.calendar(spark, d), FIRST_WEEK, LAST_WEEK)


def _sql_panel(share: int) -> dict[str, str]:
    return {
        "active": f"SELECT pharmacy_id, week_id FROM weekly_panel WHERE week_id BETWEEN {FIRST_WEEK} AND {LAST_WEEK} AND pat_actn_ind = 1 UNION {_OVERRIDE_WEEKS}",
        "needed": f"SELECT count(DISTINCT week_id) * {share} // 100 AS n FROM calendar WHERE week_id BETWEEN {FIRST_WEEK} AND {LAST_WEEK}",
        "stable": f"""SELECT t.pharmacy_id, elig_period_cnt, left(trim(coalesce(chnl_cd, 'z')), 1) AS chnl_cd, left(trim(coalesce(store_typ_cd, 'z')), 1) AS store_typ_cd,
            '1995-01-01' AS stable_period_start, '2001-12-31' AS stable_period_end, CAST({FIRST_MONTH} AS BIGINT) AS cohort_id
            FROM (SELECT pharmacy_id, count(DISTINCT week_id) AS elig_period_cnt FROM active GROUP BY pharmacy_id) t
            LEFT JOIN unit_dimension x ON t.pharmacy_id = x.pharmacy_id WHERE elig_period_cnt >= (SELECT n FROM needed)""",
    }


_PANEL_ROLES = ("calendar", "weekly_panel", "overrides", "unit_dimension")


def _panel(spark, d, share: int) -> DataFrame:
    return panel.stable_units(
        b.weekly_panel(spark, d),
        b.calendar(spark, d),
        FIRST_MONTH,
        LAST_MONTH,
        overrides=b.overrides(spark, d),
        dimension=b.unit_dimension(spark, d),
        time_share=share,
    )


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("stable_period_start", "stable_period_end")})


@register("panel_stable_units", with_roles(*_PANEL_ROLES, **_sql_panel(UNIT_SHARE)) + "SELECT * FROM stable")
def panel_stable_units(spark, d):
    return _dates_as_text(_panel(spark, d, UNIT_SHARE))


_BULK = {
    "cohorts": _sql_cohorts("M", _MONTH_ENDS).replace("least(", "(").replace(", 200109)", ")"),
    "windows": f"""SELECT CAST(cohort AS BIGINT) AS cohort_id, s, e, {sql_week('s')} AS first_week, {sql_week('e')} AS last_week FROM
        (SELECT cohort, make_date(lookback // 100, lookback % 100, 1) AS s, last_day(make_date(start // 100, start % 100, 1)) AS e FROM cohorts)""",
    "active": """SELECT pharmacy_id, week_id FROM weekly_panel WHERE pat_actn_ind = 1
        UNION SELECT pharmacy_id, week_id FROM overrides JOIN (SELECT DISTINCT week_id FROM calendar) ON week_id BETWEEN start_week_id AND end_week_id""",
    "needed": f"""SELECT cohort_id, s, e, count(c.week_id) * {UNIT_SHARE} // 100 AS n FROM windows LEFT JOIN (SELECT DISTINCT week_id FROM calendar) c
        ON c.week_id BETWEEN first_week AND last_week GROUP BY ALL""",
    "counted": """SELECT pharmacy_id, cohort_id, s, e, count(*) AS elig_period_cnt FROM active JOIN windows ON week_id BETWEEN first_week AND last_week GROUP BY ALL""",
}


_SQL_QUARTERS = f"""SELECT CAST(row_number() OVER (ORDER BY day) AS INT) AS cohort, {sql_month('day')} AS start, {sql_month("(day - INTERVAL 2 MONTH)")} AS lookback FROM ({_QUARTER_ENDS})"""
# Months and quarters are both numbered from 1, so cohorts have two windows.
_MONTHS_AND_QUARTERS = {**_BULK, "cohorts": f"SELECT cohort, start, lookback FROM ({_BULK['cohorts']}) UNION ALL SELECT cohort, start, lookback FROM ({_SQL_QUARTERS})"}


@register(
    "panel_stable_units_bulk",
    with_roles(*_PANEL_ROLES, **_MONTHS_AND_QUARTERS)
    + """SELECT t.pharmacy_id, elig_period_cnt, left(trim(coalesce(chnl_cd, 'z')), 1) AS chnl_cd, left(trim(coalesce(store_typ_cd, 'z')), 1) AS store_typ_cd,
    CAST(s AS VARCHAR) AS stable_period_start, CAST(e AS VARCHAR) AS stable_period_end, cohort_id
    FROM counted t JOIN needed n USING (cohort_id, s, e) LEFT JOIN unit_dimension x ON t.pharmacy_id = x.pharmacy_id WHERE elig_period_cnt >= n.n""",
)
def panel_stable_units_bulk(spark, d):
    bounds = b.known_bounds(spark, d)
    cohorts = cal.cohort_periods_between(bounds).unionByName(cal.cohort_periods_between(bounds, "Q", lookback=3))
    found = panel.stable_units_bulk(
        b.weekly_panel(spark, d), cal.calendar_between(bounds), cohorts, b.overrides(spark, d), b.unit_dimension(spark, d), UNIT_SHARE
    )
    return _dates_as_text(found)


@register(
    "panel_refreshed_range",
    with_roles("weeks_refreshed") + "SELECT min(week_id) AS min_week_id, max(data_refresh_ind * week_id) AS max_week_id FROM weeks_refreshed",
)
def panel_refreshed_range(spark, d):
    return cal.refreshed_range(b.weeks_refreshed(spark, d))


_SQL_PATIENTS = {
    **_sql_panel(PATIENT_SHARE),
    "unstable": "SELECT patient_id FROM patient_data p WHERE NOT EXISTS (SELECT 1 FROM stable s WHERE s.pharmacy_id = p.pharmacy_id)",
    "kept": "SELECT * FROM patient_data p WHERE NOT EXISTS (SELECT 1 FROM unstable u WHERE u.patient_id = p.patient_id)",
    "patients": """SELECT cohort_id, patient_id, stable_period_start, stable_period_end, string_agg(DISTINCT chnl_cd, ',' ORDER BY chnl_cd) AS cnls_cds
        FROM kept k LEFT JOIN stable s ON k.pharmacy_id = s.pharmacy_id GROUP BY ALL""",
}


def _patients(spark, d) -> DataFrame:
    found = panel.stable_patients(b.patient_data(spark, d), _panel(spark, d, PATIENT_SHARE))
    return _dates_as_text(found).withColumn("cnls_cds", F.array_join("cnls_cds", ","))


@register("panel_stable_patients", with_roles(*_PANEL_ROLES, "patient_data", **_SQL_PATIENTS) + "SELECT * FROM patients")
def panel_stable_patients(spark, d):
    return _patients(spark, d)


_QUARTERS = {
    **_BULK,
    "cohorts": _SQL_QUARTERS,
    "stable": "SELECT t.pharmacy_id, cohort_id, s, e, left(trim(coalesce(chnl_cd, 'z')), 1) AS chnl_cd FROM counted t JOIN needed n USING (cohort_id, s, e) LEFT JOIN unit_dimension x ON t.pharmacy_id = x.pharmacy_id WHERE elig_period_cnt >= n.n",
    "seen": f"SELECT DISTINCT o_custkey AS patient_id, l_suppkey AS pharmacy_id, cohort_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN windows ON {sql_week(SHIP)} BETWEEN first_week AND last_week",
    "unstable": "SELECT patient_id, cohort_id FROM seen p WHERE NOT EXISTS (SELECT 1 FROM stable s WHERE s.pharmacy_id = p.pharmacy_id AND s.cohort_id = p.cohort_id)",
    "kept": "SELECT * FROM seen p WHERE NOT EXISTS (SELECT 1 FROM unstable u WHERE u.patient_id = p.patient_id AND u.cohort_id = p.cohort_id)",
}


_TWO_COHORTS = {
    **_sql_panel(PATIENT_SHARE),
    "two": "SELECT pharmacy_id, chnl_cd, stable_period_start, stable_period_end, cohort_id FROM stable UNION ALL SELECT pharmacy_id, chnl_cd, stable_period_start, stable_period_end, 7 FROM stable WHERE pharmacy_id % 2 = 0",
    "unstable": "SELECT patient_id FROM patient_data p WHERE NOT EXISTS (SELECT 1 FROM two s WHERE s.pharmacy_id = p.pharmacy_id)",
    "kept": "SELECT * FROM patient_data p WHERE NOT EXISTS (SELECT 1 FROM unstable u WHERE u.patient_id = p.patient_id)",
}


@register(
    "panel_stable_patients_cohorts",
    with_roles(*_PANEL_ROLES, "patient_data", **_TWO_COHORTS)
    + """SELECT cohort_id, patient_id, stable_period_start, stable_period_end, string_agg(DISTINCT chnl_cd, ',' ORDER BY chnl_cd) AS cnls_cds
    FROM kept k JOIN two s ON k.pharmacy_id = s.pharmacy_id GROUP BY ALL""",
)
def panel_stable_patients_cohorts(spark, d):
    """A panel of two cohorts and patients without a cohort: stable patients come back for each cohort they use."""
    one = _panel(spark, d, PATIENT_SHARE)
    two = one.unionByName(one.where(F.col("pharmacy_id") % 2 == 0).withColumn("cohort_id", F.lit(7).cast("bigint")))
    found = panel.stable_patients(b.patient_data(spark, d), two)
    return _dates_as_text(found).withColumn("cnls_cds", F.array_join("cnls_cds", ","))


@register(
    "panel_stable_patients_bulk",
    with_roles(*_PANEL_ROLES, **_QUARTERS)
    + """SELECT k.cohort_id, patient_id, CAST(s AS VARCHAR) AS stable_period_start, CAST(e AS VARCHAR) AS stable_period_end,
    string_agg(DISTINCT chnl_cd, ',' ORDER BY chnl_cd) AS cnls_cds FROM kept k JOIN stable s ON k.pharmacy_id = s.pharmacy_id AND k.cohort_id = s.cohort_id GROUP BY ALL""",
)
def panel_stable_patients_bulk(spark, d):
    """One cohort per quarter; a patient is judged by the units used in that quarter."""
    bounds = b.known_bounds(spark, d)
    days = cal.calendar_between(bounds)
    windows = panel.Windows(spark, cal.cohort_periods_between(bounds, "Q", lookback=3), days)
    units = panel.stable_units_bulk(b.weekly_panel(spark, d), days, windows, b.overrides(spark, d), b.unit_dimension(spark, d), UNIT_SHARE)
    found = panel.stable_patients_bulk(b.patient_weeks(spark, d), units, days, windows)
    return _dates_as_text(found).withColumn("cnls_cds", F.array_join("cnls_cds", ","))


@register(
    "panel_eligible_patients",
    with_roles("patient_data")
    + f"""SELECT DISTINCT patient_id FROM patient_data p WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = p.patient_id AND o_orderdate < TIMESTAMP '1996-01-01')
    AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = p.patient_id AND {sql_month(ORDERED)} BETWEEN 200104 AND 200106)""",
)
def panel_eligible_patients(spark, d):
    people = b.patient_data(spark, d).select("patient_id").distinct()
    return panel.eligible_patients(people, b.patient_starts(spark, d), b.patient_months(spark, d), start=1996, end=200106)


@register(
    "panel_saved_cohorts",
    with_roles(*_PANEL_ROLES, **_sql_panel(UNIT_SHARE))
    + "SELECT * FROM stable UNION ALL SELECT pharmacy_id, elig_period_cnt, chnl_cd, store_typ_cd, stable_period_start, stable_period_end, CAST(7 AS BIGINT) FROM stable",
)
def panel_saved_cohorts(spark, d):
    """Cohort 7 is saved twice, first with other counts; the first cohort stays as it was saved."""
    name = work_table(spark, "saved_cohorts")
    first = collect.save_cohorts(_panel(spark, d, UNIT_SHARE), name)
    seventh = first.where(F.col("cohort_id") == FIRST_MONTH).withColumn("cohort_id", F.lit(7).cast("bigint"))
    collect.save_cohorts(seventh.withColumn("elig_period_cnt", F.col("elig_period_cnt") + 1), name)
    return _dates_as_text(collect.save_cohorts(seventh, name))


# ---- extraction --------------------------------------------------------------------------------

_OWN = "claim_id, svc_nbr, diag_cd_posn_nbr, ndc, prc_cd, diag_cd, diag_vers_typ_id, patient_id"
_OUT_DX = [
    "claim_id", "svc_nbr", "ndc", "prc_cd", "diag_cd", "diag_vers_typ_id", "patient_id", "cast(load_dt as string) as load_dt",
    "coalesce(pat_age_yr_nbr, -1) as pat_age_yr_nbr", "svc_crgd_amt", "week_id", "month_id",
]
_OUT_RX = [*_OUT_DX[:-2], "payer_id", "coalesce(payer_hist_id, -1) as payer_hist_id", "coalesce(plan_hist_id, -1) as plan_hist_id", "week_id", "month_id"]

_SQL_LISTS = {
    extract.BY_DIAGNOSIS: "SELECT p_type AS diag_cd, CASE WHEN p_size > 25 THEN 10 ELSE 9 END AS diag_vers_typ_id FROM part WHERE p_retailprice < 901",
    extract.BY_PROCEDURE: "SELECT p_brand AS prc_cd FROM part WHERE p_retailprice < 901",
    extract.BY_PRODUCT: "SELECT p_partkey AS ndc FROM part WHERE p_type IN ('PROMO', 'SMALL')",
    extract.BY_PATIENT: "SELECT c_custkey AS patient_id FROM customer WHERE c_mktsegment = 'BUILDING'",
}


def _sql_extract(keys: tuple[str, ...], rx: bool) -> str:
    listed = "EXISTS (SELECT 1 FROM key_list k WHERE " + " AND ".join(f"k.{k} = c.{k}" for k in keys) + ")"
    age = "CAST(year(order_dt) - 1930 AS INT) AS pat_age_yr_nbr"
    rest = "svc_crgd_amt, week_id, month_id"
    gap_history = "pharmacy_id AS payer_id, pharmacy_id AS payer_hist_id, svc_nbr AS plan_hist_id, " if rx else ""
    main_history = "a.pharmacy_id AS payer_id, b.pharmacy_id AS payer_hist_id, b.svc_nbr AS plan_hist_id, " if rx else ""
    match = "a.claim_id = b.claim_id AND a.month_id = b.month_id"
    if not rx:
        match += " AND a.diag_cd_posn_nbr = b.diag_cd_posn_nbr AND a.svc_nbr = b.svc_nbr"
    own = ", ".join(f"a.{c.strip()}" for c in _OWN.split(","))
    out = ", ".join(_OUT_RX if rx else _OUT_DX).replace("as string", "AS VARCHAR")
    return (
        with_roles(
            "in_months",
            key_list=_SQL_LISTS[keys],
            listed=f"SELECT * FROM in_months c WHERE {listed}",
            merged=f"""SELECT {_OWN}, order_dt AS load_dt, {age}, {gap_history}{rest} FROM listed WHERE l_returnflag = 'A'
            UNION SELECT {own}, coalesce(b.order_dt, a.svc_dt), CAST(year(b.order_dt) - 1930 AS INT), {main_history}a.svc_crgd_amt, a.week_id, a.month_id
            FROM (SELECT * FROM listed WHERE l_returnflag <> 'A') a
            LEFT JOIN (SELECT * FROM listed WHERE l_returnflag <> 'A' AND l_linestatus = 'O') b ON {match}""",
        )
        + f"SELECT {out} FROM merged"
    )


def _by_pair(spark, d, by_month: bool = False) -> DataFrame:
    return extract.dx_by_diagnosis(*b.feeds(spark, d), b.diagnosis_list(spark, d), b.DIAGNOSIS, b.calendar(spark, d), FIRST_MONTH, LAST_MONTH, _OUT_DX, by_month)


@register("extract_by_code_pair", _sql_extract(extract.BY_DIAGNOSIS, False))
def extract_by_code_pair(spark, d):
    return _by_pair(spark, d)


@register("extract_by_code", _sql_extract(extract.BY_PROCEDURE, False))
def extract_by_code(spark, d):
    return extract.dx_by_procedure(*b.feeds(spark, d), b.procedure_list(spark, d), b.DIAGNOSIS, b.calendar(spark, d), FIRST_MONTH, LAST_MONTH, _OUT_DX)


@register("extract_by_patient", _sql_extract(extract.BY_PATIENT, False))
def extract_by_patient(spark, d):
    return extract.dx_by_patient(*b.feeds(spark, d), b.patient_list(spark, d), b.DIAGNOSIS, b.calendar(spark, d), FIRST_MONTH, LAST_MONTH, _OUT_DX)


@register("extract_rx_by_product", _sql_extract(extract.BY_PRODUCT, True))
def extract_rx_by_product(spark, d):
    return extract.rx_by_product(*b.feeds(spark, d, True), b.product_list(spark, d), b.PRESCRIPTION, b.calendar(spark, d), FIRST_MONTH, LAST_MONTH, _OUT_RX)


@register("extract_rx_by_patient", _sql_extract(extract.BY_PATIENT, True))
def extract_rx_by_patient(spark, d):
    return extract.rx_by_patient(*b.feeds(spark, d, True), b.patient_list(spark, d), b.PRESCRIPTION, b.calendar(spark, d), FIRST_MONTH, LAST_MONTH, _OUT_RX)


@register("extract_stored", _sql_extract(extract.BY_DIAGNOSIS, False))
def extract_stored(spark, d):
    return collect.store_extract(_by_pair(spark, d, True), work_table(spark, "extract_stored"), b.calendar(spark, d), FIRST_MONTH, LAST_MONTH, by_month=True)


# ---- period loads and partition replacement ----------------------------------------------------

_SHIPPED = with_roles("shipments") + "SELECT l_orderkey, l_linenumber, l_quantity, week_id, month_id FROM shipments"
_SHIPPED_IN_MONTHS = (
    with_roles("shipments", "month_weeks")
    + "SELECT s.* FROM shipments s JOIN month_weeks m ON s.month_id = m.month_id AND s.week_id BETWEEN m.begin_week_id AND m.end_week_id"
)


@register("collect_months", _SHIPPED_IN_MONTHS)
def collect_months(spark, d):
    return collect.collect_periods(spark, b.shipments(spark, d), work_table(spark, "months"), FIRST_MONTH, LAST_MONTH, b.calendar(spark, d), files=2)


@register("collect_weeks", _SHIPPED + f" WHERE week_id BETWEEN {FIRST_WEEK} AND {LAST_WEEK}")
def collect_weeks(spark, d):
    return collect.collect_periods(
        spark, b.shipments(spark, d), work_table(spark, "weeks"), FIRST_WEEK, LAST_WEEK, b.calendar(spark, d), period="week_id"
    )


@register("collect_replace_empty_period", _SHIPPED_IN_MONTHS + " WHERE s.month_id NOT BETWEEN 199807 AND 199812")
def collect_replace_empty_period(spark, d):
    """A second load of 1998 finds rows for its first half only, so the second half ends empty."""
    name, days = work_table(spark, "empty_period"), b.calendar(spark, d)
    collect.collect_periods(spark, b.shipments(spark, d), name, FIRST_MONTH, LAST_MONTH, days)
    half = b.shipments(spark, d).where(F.col("month_id") <= 199806)
    return collect.collect_periods(spark, half, name, 199801, 199812, days, method="APPEND")


def _yearly(spark, d) -> DataFrame:
    return b.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", cal.year_id("o_orderdate").alias("year_id"))


_YEARLY = "SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS year_id FROM orders"


@register("add_partition", _YEARLY)
def add_partition(spark, d):
    """All years come in with changed prices for 1996, then 1996 is added again as it should be."""
    name, rows = work_table(spark, "add_partition"), _yearly(spark, d)
    year = F.col("year_id") == 1996
    raised = rows.withColumn("o_totalprice", F.when(year, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    collect.add_partition(spark, raised, name, "year_id", 1996, method="APPEND")
    return collect.add_partition(spark, rows.where(year), name, "year_id", 1996)


@register("save_replace_partitions", f"SELECT o_orderkey, o_custkey, CASE WHEN year_id = 1999 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, year_id FROM ({_YEARLY})")
def save_replace_partitions(spark, d):
    name, rows = work_table(spark, "replaced"), _yearly(spark, d)
    writers.replace_partitions(rows, name, "year_id")
    changed = rows.where(F.col("year_id") == 1999).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    writers.replace_partitions(changed, name, "year_id")
    return spark.table(name)


@register("save_upper", 'SELECT o_orderkey AS "O_ORDERKEY", o_custkey AS "O_CUSTKEY", o_totalprice AS "O_TOTALPRICE", year_id AS "YEAR_ID" FROM (' + _YEARLY + ") x, (VALUES (1), (2)) t(i)")
def save_upper(spark, d):
    name, rows = work_table(spark, "upper"), _yearly(spark, d)
    writers.save_table(rows, name, "year_id", upper=True, files=2, analyze=True)
    writers.save_table(rows, name, "year_id", upper=True, cache=True)
    return spark.table(name)


@register("run_insert", _YEARLY)
def run_insert(spark, d):
    name, rows = work_table(spark, "inserted"), _yearly(spark, d)
    writers.save_table(rows.where(F.col("year_id") <= 1998), name)
    rows.createOrReplaceTempView("cohortkit_yearly")
    writers.run_insert(spark, name, f"INSERT INTO {name} SELECT * FROM cohortkit_yearly WHERE year_id > 1998")
    return spark.table(name)


@register("table_compact", f"SELECT * FROM ({_YEARLY}) x, (VALUES ('parts'), ('whole')) t(kind)")
def table_compact(spark, d):
    found = []
    for kind, part in (("parts", "year_id"), ("whole", None)):
        name = work_table(spark, f"compact_{kind}")
        writers.save_table(_yearly(spark, d).repartition(8), name, part, files=4)
        tables.compact(spark, name, part)
        found.append(spark.table(name).withColumn("kind", F.lit(kind)))
    return found[0].unionByName(found[1])


_LINES = "SELECT DISTINCT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INT) AS year_id FROM lineitem"


@register("table_dedupe", f"SELECT * FROM ({_LINES}) x, (VALUES ('parts'), ('whole')) t(kind)")
def table_dedupe(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cal.year_id("l_shipdate").alias("year_id"))
    found = []
    for kind, part in (("parts", "year_id"), ("whole", None)):
        name = work_table(spark, f"dedupe_{kind}")
        writers.save_table(rows, name, part)
        tables.dedupe(spark, name, part)
        found.append(spark.table(name).withColumn("kind", F.lit(kind)))
    return found[0].unionByName(found[1])


@register("table_partitions", f"SELECT year_id, count(*) AS record_count FROM ({_YEARLY}) WHERE year_id <> 1998 GROUP BY year_id")
def table_partitions(spark, d):
    """A table made from the query's schema is filled, emptied, filled again and loses one partition."""
    name, rows = work_table(spark, "partitions"), _yearly(spark, d)
    tables.drop(spark, name)
    writers.create_like(rows, name, "year_id")
    writers.insert_by_name(rows, name)
    tables.truncate(spark, name)
    writers.insert_by_name(writers.spread_for_write(rows, "year_id"), name)
    tables.drop_partition(spark, name, "year_id", 1998)
    tables.analyze(spark, name, "year_id", 1999)
    return tables.partition_counts(spark, name, "year_id")


@register("table_statistics", f"SELECT CAST(year_id AS VARCHAR) AS partition, count(*) AS rows, true AS has_bytes FROM ({_YEARLY}) GROUP BY year_id")
def table_statistics(spark, d):
    """What the catalog holds per partition after two loads, the second one of 1997 alone."""
    name, rows = work_table(spark, "statistics"), _yearly(spark, d)
    collect.add_partition(spark, rows.where("year_id <> 1997 OR o_orderkey % 2 = 0"), name, "year_id", 1996)
    collect.add_partition(spark, rows.where("year_id = 1997"), name, "year_id", 1997)
    return tables.partition_statistics(spark, name).select("partition", "rows", (F.col("bytes") > 0).alias("has_bytes"))


# ---- files and source resolution ---------------------------------------------------------------


@register("csv_roundtrip", "SELECT event_id, user_id, event_type, value, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS stamp FROM events")
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    rows = b.table(spark, d, "events").select(
        F.col("event_id").alias("EVENT_ID"), F.col("user_id").alias("USER_ID"), "event_type", "value", cal.stamp("ts").alias("stamp")
    )
    writers.write_csv(rows, path, sep="|", compression="gzip")
    schema = "event_id bigint, user_id bigint, event_type string, value double, stamp bigint"
    return readers.read_csv_dir(spark, path, schema=schema, sep="|", pattern="*.csv.gz")


@register("parquet_dir", "SELECT o_orderkey, o_totalprice FROM orders")
def parquet_dir(spark, d):
    path = scratch_path(spark, "parquet")
    b.table(spark, d, "orders").select("o_orderkey", "o_totalprice").repartition(4).write.parquet(path)
    return readers.read_parquet(spark, path)


@register("source_resolve", "SELECT o_orderkey, o_custkey, kind FROM orders, (VALUES ('frame'), ('query'), ('table')) t(kind)")
def source_resolve(spark, d):
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    orders.createOrReplaceTempView("cohortkit_orders")
    name = work_table(spark, "resolved")
    writers.save_table(orders, name)
    sources = {
        "frame": orders,
        "query": "/* all */ -- orders\n select o_orderkey, o_custkey from cohortkit_orders",
        "table": name.split(".")[1],
    }
    found = [readers.resolve(spark, s, WORK).withColumn("kind", F.lit(k)) for k, s in sources.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


# ---- quality -----------------------------------------------------------------------------------


@register(
    "qc_missing_periods",
    with_roles("calendar") + f"SELECT month_id FROM calendar EXCEPT SELECT {sql_month(SHIP)} FROM lineitem",
)
def qc_missing_periods(spark, d):
    return quality.missing_periods(b.shipments(spark, d), b.calendar(spark, d), FIRST_MONTH, LAST_MONTH)


_DAYS_SHIPPED = f"SELECT {sql_date_id(SHIP)} AS date_id FROM lineitem"
_DAYS_ORDERED = f"SELECT {sql_date_id(ORDERED)} AS date_id FROM orders"


@register("qc_symmetric_difference", f"({_DAYS_SHIPPED} EXCEPT {_DAYS_ORDERED}) UNION ALL ({_DAYS_ORDERED} EXCEPT {_DAYS_SHIPPED})")
def qc_symmetric_difference(spark, d):
    shipped = b.table(spark, d, "lineitem").select(cal.date_id("l_shipdate").alias("date_id"))
    ordered = b.table(spark, d, "orders").select(cal.date_id("o_orderdate").alias("date_id"))
    return frames.symmetric_difference(shipped, ordered)


@register(
    "qc_coverage",
    f"""SELECT count(DISTINCT {sql_month(SHIP)}) AS number_of_months,
    CAST(datediff('month', min(l_shipdate), max(l_shipdate)) + 1 AS INT) AS number_of_datamonths FROM lineitem""",
)
def qc_coverage(spark, d):
    return quality.month_coverage(b.shipments(spark, d))


@register("qc_rows_per_period", f"SELECT {sql_month(SHIP)} AS month_id, count(*) AS record_count FROM lineitem GROUP BY 1")
def qc_rows_per_period(spark, d):
    return quality.rows_per_period(b.shipments(spark, d))


@register(
    "qc_freshness",
    f"""SELECT CAST(m AS VARCHAR) AS max_dt, CAST(m + 1 - CAST((isodow(m + 1) + 1) % 7 + 1 AS INT) AS VARCHAR) AS expected_dt,
    CAST(m = m + 1 - CAST((isodow(m + 1) + 1) % 7 + 1 AS INT) AS INT) AS is_fresh FROM (SELECT max({SHIP}) AS m FROM lineitem)""",
)
def qc_freshness(spark, d):
    """Judged on the day after the newest shipment."""
    lines = b.table(spark, d, "lineitem")
    today = lines.agg(F.date_add(F.to_date(F.max("l_shipdate")), 1)).scalar()
    found = quality.freshness(lines, "l_shipdate", today)
    return found.select(*[F.col(c).cast("string").alias(c) for c in ("max_dt", "expected_dt")], F.col("is_fresh").cast("int").alias("is_fresh"))


# ---- metrics -----------------------------------------------------------------------------------

_SIZES = (1, 10, 50)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _sql_at_k(model: str) -> str:
    return f"""SELECT CAST(k AS BIGINT) AS k, round(sum(y_true) / count(*), 6) AS precision, round(sum(y_true) / (SELECT sum(y_true) FROM scores WHERE model = '{model}'), 6) AS recall, threshold
    FROM (SELECT k, y_true, threshold FROM (SELECT k, (SELECT min(score) FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM scores WHERE model = '{model}') WHERE r <= k) AS threshold
    FROM (VALUES {', '.join(f'({k})' for k in _SIZES)}) t(k)) JOIN scores ON model = '{model}' AND score >= threshold) GROUP BY k, threshold"""


def _one_model(spark, d) -> DataFrame:
    return b.scores(spark, d).where(F.col("model") == "quality").drop("model")


@register("metric_at_k", with_roles("scores") + _sql_at_k("quality"))
def metric_at_k(spark, d):
    return _rounded(metrics.precision_recall_at_k(_one_model(spark, d), _SIZES), "precision", "recall")


_PR = """SELECT {group} CAST(threshold AS VARCHAR) AS threshold, round(cum_tp / (cum_tp + cum_fp), 6) AS precision, round(cum_tp / all_tp, 6) AS recall FROM score_table {where}
    UNION ALL SELECT DISTINCT {group} NULL, 1.0, 0.0 FROM score_table {where}"""
_ROC = """SELECT {group} CAST(threshold AS VARCHAR) AS threshold, round(cum_fp / all_fp, 6) AS fpr, round(cum_tp / all_tp, 6) AS tpr FROM score_table
    WHERE (next_tp IS NULL OR next_tp <> tp OR next_fp <> fp OR cum_tp + cum_fp = tp + fp) {where}
    UNION ALL SELECT DISTINCT {group} NULL, 0.0, 0.0 FROM score_table WHERE true {where}"""
_AP = "round(sum(tp / all_tp * cum_tp / (cum_tp + cum_fp)), 6) AS average_precision"
_AUC = "round(CAST(sum(fp * (2 * cum_tp - tp)) AS DOUBLE) / (2.0 * max(all_tp) * max(all_fp)), 6) AS roc_auc"


@register("metric_pr_curve", with_roles("score_table") + _PR.format(group="", where="WHERE model = 'quality'"))
def metric_pr_curve(spark, d):
    curve = _rounded(metrics.pr_curve(_one_model(spark, d)), "precision", "recall")
    return curve.withColumn("threshold", F.col("threshold").cast("string"))


@register("metric_average_precision", with_roles("score_table") + f"SELECT {_AP} FROM score_table WHERE model = 'quality'")
def metric_average_precision(spark, d):
    return _rounded(metrics.average_precision(_one_model(spark, d)), "average_precision")


@register("metric_roc_curve", with_roles("score_table") + _ROC.format(group="", where="AND model = 'quality'"))
def metric_roc_curve(spark, d):
    curve = _rounded(metrics.roc_curve(_one_model(spark, d)), "fpr", "tpr")
    return curve.withColumn("threshold", F.col("threshold").cast("string"))


@register("metric_roc_auc", with_roles("score_table") + f"SELECT {_AUC} FROM score_table WHERE model = 'quality'")
def metric_roc_auc(spark, d):
    return _rounded(metrics.roc_auc(_one_model(spark, d)), "roc_auc")


@register("metric_multi_pr", with_roles("score_table") + _PR.format(group="model,", where=""))
def metric_multi_pr(spark, d):
    curve = _rounded(metrics.pr_curve(b.scores(spark, d), by="model"), "precision", "recall")
    return curve.withColumn("threshold", F.col("threshold").cast("string"))


@register("metric_multi_roc", with_roles("score_table") + _ROC.format(group="model,", where=""))
def metric_multi_roc(spark, d):
    curve = _rounded(metrics.roc_curve(b.scores(spark, d), by="model"), "fpr", "tpr")
    return curve.withColumn("threshold", F.col("threshold").cast("string"))


@register("metric_multi_area", with_roles("score_table") + f"SELECT model, {_AP}, {_AUC} FROM score_table GROUP BY model")
def metric_multi_area(spark, d):
    return _rounded(metrics.areas(b.scores(spark, d), by="model"), "average_precision", "roc_auc")


# ---- sequences ---------------------------------------------------------------------------------


@register(
    "seq_length_percentiles",
    with_roles("texts")
    + f"""SELECT CAST(p AS DOUBLE) AS pct, round(v, 6) AS length FROM (SELECT unnest({list(sequences.PERCENTILES)}) AS p,
    unnest(quantile_cont(len(words), {[p / 100 for p in sequences.PERCENTILES]})) AS v FROM texts)""",
)
def seq_length_percentiles(spark, d):
    return _rounded(sequences.length_percentiles(b.word_sequences(spark, d)), "length")


@register("seq_vocab", with_roles("word_vocab") + "SELECT token, idx AS index, n AS count FROM word_vocab")
def seq_vocab(spark, d):
    return sequences.build_vocab(b.word_sequences(spark, d), "doc_id")


@register(
    "seq_encode",
    with_roles(
        "word_vocab",
        found=f"SELECT doc_id, list(idx ORDER BY pos) AS ids FROM word_tokens JOIN word_vocab USING (token) WHERE idx < {MAX_WORDS} GROUP BY doc_id",
        tail=f"SELECT d.doc_id, coalesce(ids[-least(len(ids), {MAX_LENGTH}):], []) AS ids FROM documents d LEFT JOIN found USING (doc_id)",
    )
    + "SELECT doc_id, "
    + ", ".join(f"CAST(coalesce(ids[{i + 1}], 0) AS INT) AS seq_{i}" for i in range(MAX_LENGTH))
    + " FROM tail",
)
def seq_encode(spark, d):
    return sequences.encode(b.word_sequences(spark, d), "doc_id", MAX_WORDS, MAX_LENGTH)


@register(
    "seq_embedding_matrix",
    with_roles(
        event_tokens="SELECT event_id AS e, 1 AS pos, event_type AS token FROM events UNION ALL SELECT event_id, 2, CAST(user_id AS VARCHAR) FROM events",
        vocab="SELECT token, row_number() OVER (ORDER BY count(*) DESC, min(e * 10 + pos)) AS idx FROM event_tokens GROUP BY token",
        slots=f"SELECT unnest(range({MAX_FEATURES})) AS index",
        cells=f"SELECT index, unnest(range({VECTOR_DIM})) AS dim FROM slots",
    )
    + """SELECT c.index, CAST(dim AS INT) AS dim, round(CAST(coalesce(embedding[dim + 1], 0) AS DOUBLE), 6) AS value
    FROM cells c LEFT JOIN vocab ON idx = c.index LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = token""",
)
def seq_embedding_matrix(spark, d):
    """The vectors pass through a text file of ``word v1 v2 …`` lines."""
    path = scratch_path(spark, "vectors")
    vectors = b.table(spark, d, "embeddings")
    values = F.transform("embedding", lambda v: v.cast("string"))
    vectors.select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(values, " "))).write.text(path)
    vocab = sequences.build_vocab(b.event_sequences(spark, d), "event_id")
    wanted = vocab.where(F.col("index") < MAX_FEATURES).select("index", "token")
    lines = sequences.load_vectors(spark, path, wanted.select(F.col("token").alias("word")))
    matrix = sequences.embedding_matrix(wanted, lines, MAX_FEATURES, VECTOR_DIM)
    return matrix.select("index", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


# ---- text search, chunks, vectors, correlation ---------------------------------------------------

KEYWORDS = {"english": ["the", "of", "and"], "german": ["und", "der", "in"], "mixed": ["que", "le"], "cased": ["The", "LICENSE"]}
PHRASES = {"two": ["of", "the"], "repeated": ["the", "the"], "three": ["in", "the", "of"], "spanish": ["de", "la"]}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _sql_rows(queries: dict[str, list[str]]) -> str:
    return ", ".join(f"('{name}', {i}, '{term.lower()}')" for name, terms in queries.items() for i, term in enumerate(terms))


def _index(spark, d) -> DataFrame:
    return search.build_index(b.table(spark, d, "documents"), scratch_path(spark, "postings"))


@register(
    "search_terms",
    f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits FROM w GROUP BY term""",
)
def search_terms(spark, d):
    return search.term_statistics(_index(spark, d))


@register(
    "search_keywords",
    f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), q(query, i, term) AS (VALUES {_sql_rows(KEYWORDS)}),
    hits AS (SELECT query, doc_id, term, count(*) AS n FROM w JOIN q USING (term) GROUP BY ALL)
    SELECT query, doc_id, count(*) AS n_terms, sum(n) AS n_hits, string_agg(term || '=' || n, ' ' ORDER BY term) AS hits FROM hits
    GROUP BY query, doc_id HAVING count(*) = (SELECT count(*) FROM q WHERE q.query = hits.query)""",
)
def search_keywords(spark, d):
    found = search.search(_index(spark, d), KEYWORDS)
    listed = F.array_join(F.transform(F.map_entries("hits"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return found.select("query", F.col("doc").alias("doc_id"), "n_terms", "n_hits", listed.alias("hits"))


@register(
    "search_phrases",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), q(query, i, term) AS (VALUES {_sql_rows(PHRASES)}),
    p AS (SELECT query, list(term ORDER BY i) AS p FROM q GROUP BY query),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
    SELECT query, doc_id, count(*) AS n_hits FROM places JOIN p ON w[i] = p[1] AND w[i:i + len(p) - 1] = p GROUP BY query, doc_id""",
)
def search_phrases(spark, d):
    return search.search_phrases(_index(spark, d), PHRASES).withColumnRenamed("doc", "doc_id")


CHUNK, OVERLAP = 400, 60


def _sql_cut(size: int) -> str:
    """Characters that the next part takes from ``rest``."""
    best = [f"nullif(length(regexp_extract(left(rest, {size}), '(?s)^.*{s}')), 0)" for s in (r"\n\n", r"\n", " ")]
    return f"CASE WHEN length(rest) <= {size} THEN length(rest) ELSE coalesce({', '.join(best)}, {size}) END"


@register(
    "text_chunks",
    rf"""WITH RECURSIVE sections AS (
        SELECT doc_id, 0 AS pos, '' AS part, text AS rest FROM documents WHERE text <> ''
        UNION ALL SELECT doc_id, pos + length(part), left(rest, c), substr(rest, c + 1) FROM (SELECT *, {_sql_cut(chunks.SECTION)} AS c FROM sections WHERE rest <> '')),
    parts AS (
        SELECT doc_id, pos, '' AS part, part AS rest FROM sections WHERE part <> ''
        UNION ALL SELECT doc_id, pos + length(part), left(rest, c), substr(rest, c + 1) FROM (SELECT *, {_sql_cut(CHUNK - OVERLAP)} AS c FROM parts WHERE rest <> '')),
    behind AS (SELECT doc_id, pos, part, substr(text, greatest(pos - {OVERLAP}, 0) + 1, least(pos, {OVERLAP})) AS b FROM parts JOIN documents USING (doc_id) WHERE part <> ''),
    leads AS (SELECT *, CASE WHEN pos = length(b) THEN b ELSE coalesce(nullif(regexp_extract(b, '(?s)^.*?(?:

|
| )(.+)$', 1), ''), b) END AS l FROM behind)
    SELECT doc_id, pos - length(l) AS start, length(l) AS lead, length(l) + length(part) AS n_chars, md5(l || part) AS text_md5 FROM leads""",
)
def text_chunks(spark, d):
    found = chunks.chunk_texts(b.table(spark, d, "documents"), CHUNK, OVERLAP)
    return found.select("doc_id", "start", "lead", "n_chars", F.md5("text").alias("text_md5"))


@register(
    "vector_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank, vec_id, round(c, 6) AS score FROM s QUALIFY rank <= 5""",
)
def vector_topk(spark, d):
    given = b.table(spark, d, "embeddings")
    found = vectors.nearest(given, given.where("vec_id % 100 = 0"), 5, skip_self=True)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


_CORR = {
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "CASE WHEN l_linestatus = 'O' AND l_quantity < 10 THEN NULL ELSE l_discount END",
    "balance": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END",
    "flag": "l_returnflag",
    "segment": "c_mktsegment",
}
_CODED = ("flag", "segment")
_SQL_CORR = " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, round(corr({x}, {y}), 6) AS corr FROM coded" for x in _CORR for y in _CORR
)


@register(
    "corr_matrix",
    f"""WITH given AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _CORR.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    flags AS (SELECT flag AS v, row_number() OVER (ORDER BY flag) - 1 AS code FROM (SELECT DISTINCT flag FROM given)),
    segments AS (SELECT segment AS v, row_number() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM given)),
    coded AS (SELECT quantity, price, discount, balance, flags.code AS flag, segments.code AS segment FROM given JOIN flags ON flag = flags.v JOIN segments ON segment = segments.v)
    {_SQL_CORR}""",
)
def corr_matrix(spark, d):
    """Order lines with their customers; the categories are coded in the order of their names."""
    lines = b.table(spark, d, "lineitem").join(b.table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).join(b.table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    given = lines.select(*[F.expr(e).alias(c) for c, e in _CORR.items()])
    found = correlation.correlation_matrix(given, [c for c in _CORR if c not in _CODED], _CODED)
    return found.select("a", "b", "n", F.round("corr", 6).alias("corr"))
