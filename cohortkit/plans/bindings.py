"""The star tables seen as claims, weekly panels, dimensions and sequences, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortkit.functions import calendar as cal
from cohortkit.operators.extract import DIAGNOSIS_KEYS, PRESCRIPTION_KEYS, Domain


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A star table. Its schema is read once per path; reading it costs a job each time."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def date_bounds(spark, d) -> DataFrame:
    """First and last day of the years with shipments, in one row."""
    found = table(spark, d, "lineitem").agg(F.year(F.min("l_shipdate")).alias("a"), F.year(F.max("l_shipdate")).alias("b"))
    return found.select(
        F.make_date("a", F.lit(1), F.lit(1)).alias("first_dt"), F.make_date("b", F.lit(12), F.lit(31)).alias("last_dt")
    )


def known_bounds(spark, d) -> DataFrame:
    """:func:`date_bounds` as a local row, for plans that use the calendar several times."""
    found = date_bounds(spark, d)
    return spark.createDataFrame(found.collect(), found.schema)


def calendar(spark, d) -> DataFrame:
    return cal.calendar_between(date_bounds(spark, d))


def shipments(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", cal.week_id("l_shipdate").alias("week_id"), cal.month_id("l_shipdate").alias("month_id")
    )


def claims(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_dt"))
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    lines = table(spark, d, "lineitem")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("claim_id"),
            F.col("l_linenumber").alias("svc_nbr"),
            F.round(F.col("l_tax") * 100).cast("int").alias("diag_cd_posn_nbr"),
            F.col("l_partkey").alias("ndc"),
            F.col("p_brand").alias("prc_cd"),
            F.col("p_type").alias("diag_cd"),
            F.when(F.col("p_size") > 25, 10).otherwise(9).alias("diag_vers_typ_id"),
            F.col("o_custkey").alias("patient_id"),
            F.col("l_suppkey").alias("pharmacy_id"),
            F.col("l_extendedprice").alias("svc_crgd_amt"),
            F.to_date("l_shipdate").alias("svc_dt"),
            "order_dt",
            "l_returnflag",
            "l_linestatus",
            cal.week_id("l_shipdate").alias("week_id"),
            cal.month_id("l_shipdate").alias("month_id"),
        )
    )


_OWN = ["claim_id", "svc_nbr", "diag_cd_posn_nbr", "ndc", "prc_cd", "diag_cd", "diag_vers_typ_id", "patient_id"]
_AMOUNT = ["svc_crgd_amt", "week_id", "month_id"]


def _age():
    return (F.year("order_dt") - F.lit(1930)).alias("pat_age_yr_nbr")


# Column names of the test feeds.
DIAGNOSIS = Domain(DIAGNOSIS_KEYS, "load_dt", "main_load_dt")
PRESCRIPTION = Domain(PRESCRIPTION_KEYS, "load_dt", "main_load_dt", {"payer_hist_id": "payer_id", "plan_hist_id": "cast(plan_id as int)"})


def gap_feed(spark, d, prescription: bool = False) -> DataFrame:
    rows = claims(spark, d).where(F.col("l_returnflag") == "A")
    history = (
        [
            F.col("pharmacy_id").alias("payer_id"),
            F.col("pharmacy_id").alias("payer_hist_id"),
            F.col("svc_nbr").alias("plan_hist_id"),
        ]
        if prescription
        else []
    )
    return rows.select(*_OWN, F.col("order_dt").alias("load_dt"), _age(), *history, *_AMOUNT)


def main_feed(spark, d, prescription: bool = False) -> DataFrame:
    rows = claims(spark, d).where(F.col("l_returnflag") != "A")
    payer = [F.col("pharmacy_id").alias("payer_id")] if prescription else []
    return rows.select(*_OWN, F.col("svc_dt").alias("main_load_dt"), *payer, *_AMOUNT)


def enrichment_feed(spark, d, prescription: bool = False) -> DataFrame:
    rows = claims(spark, d).where((F.col("l_returnflag") != "A") & (F.col("l_linestatus") == "O"))
    history = (
        [F.col("pharmacy_id").alias("payer_id"), F.col("svc_nbr").cast("string").alias("plan_id")] if prescription else []
    )
    return rows.select(*_OWN, F.col("order_dt").alias("load_dt"), _age(), *history, *_AMOUNT)


def feeds(spark, d, prescription: bool = False):
    return gap_feed(spark, d, prescription), main_feed(spark, d, prescription), enrichment_feed(spark, d, prescription)


def diagnosis_list(spark, d) -> DataFrame:
    small = table(spark, d, "part").where(F.col("p_retailprice") < 901)
    return small.select(F.col("p_type").alias("diag_cd"), F.when(F.col("p_size") > 25, 10).otherwise(9).alias("diag_vers_typ_id"))


def procedure_list(spark, d) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_retailprice") < 901).select(F.col("p_brand").alias("prc_cd"))


def product_list(spark, d) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_type").isin("PROMO", "SMALL")).select(F.col("p_partkey").alias("ndc"))


def patient_list(spark, d) -> DataFrame:
    return table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("patient_id"))


def weekly_panel(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pharmacy_id"), cal.week_id("l_shipdate").alias("week_id"), "l_quantity")
    return lines.groupBy("pharmacy_id", "week_id").agg(F.when(F.sum("l_quantity") >= 25, 1).otherwise(0).alias("pat_actn_ind"))


def overrides(spark, d) -> DataFrame:
    return table(spark, d, "supplier").where(F.col("s_acctbal") < 500).select(
        F.col("s_suppkey").alias("pharmacy_id"), F.lit(19960101).alias("start_week_id"), F.lit(20001231).alias("end_week_id")
    )


def unit_dimension(spark, d) -> DataFrame:
    nation = F.col("s_nationkey")
    return table(spark, d, "supplier").where(F.col("s_acctbal") < 9000).select(
        F.col("s_suppkey").alias("pharmacy_id"),
        F.when(nation < 7, " R").when(nation < 13, "M").when(nation < 19, "L ").alias("chnl_cd"),
        F.when(F.col("s_acctbal") > 5000, "AB").otherwise("C").alias("store_typ_cd"),
    )


def patient_weeks(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("pharmacy_id"), "l_shipdate")
    placed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return placed.select("patient_id", "pharmacy_id", cal.week_id("l_shipdate").alias("week_id"))


def patient_data(spark, d) -> DataFrame:
    return patient_weeks(spark, d).select("patient_id", "pharmacy_id")


def patient_starts(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(F.min("o_orderdate").alias("pat_strt_dt_rx"))


def patient_months(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), cal.month_id("o_orderdate").alias("month_id"))


def weeks_refreshed(spark, d) -> DataFrame:
    """Shipment weeks; the flag is set while orders still came in."""
    last_order = table(spark, d, "orders").agg(F.max(cal.week_id("o_orderdate")))
    weeks = table(spark, d, "lineitem").select(cal.week_id("l_shipdate").alias("week_id")).distinct()
    return weeks.select("week_id", (F.col("week_id") <= last_order.scalar()).cast("int").alias("data_refresh_ind"))


def scores(spark, d) -> DataFrame:
    """Two models over the labelled documents: quality and toxicity against the text length."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    labelled = table(spark, d, "labels").join(docs, "doc_id")
    pairs = F.array(
        F.struct(F.lit("quality").alias("model"), F.col("quality").alias("y_true")),
        F.struct(F.lit("toxic").alias("model"), F.col("toxic").alias("y_true")),
    )
    return labelled.select(F.explode(pairs).alias("m"), "score").select("m.model", "m.y_true", "score")


def word_sequences(spark, d) -> DataFrame:
    """Whole document texts with their words as tokens."""
    return table(spark, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit(" "), F.lit("|")), F.lit("\n"), F.lit("|")).alias("text"))


def event_sequences(spark, d) -> DataFrame:
    """Two tokens per event: what happened and who did it."""
    return table(spark, d, "events").select("event_id", F.concat_ws("|", "event_type", "user_id").alias("text"))


# ---- the same roles in DuckDB SQL --------------------------------------------------------------


def sql_date_id(day: str) -> str:
    return f"CAST(strftime({day}, '%Y%m%d') AS INT)"


def sql_week(day: str) -> str:
    return f"CAST(strftime({day} + CAST((12 - isodow({day})) % 7 AS INT), '%Y%m%d') AS INT)"


def sql_month(day: str) -> str:
    return f"CAST(year({day}) * 100 + month({day}) AS INT)"


SHIP = "CAST(l_shipdate AS DATE)"
ORDERED = "CAST(o_orderdate AS DATE)"

_ROLES = {
    "date_bounds": "SELECT make_date(year(min(l_shipdate)), 1, 1) AS first_dt, make_date(year(max(l_shipdate)), 12, 31) AS last_dt FROM lineitem",
    "calendar_days": "SELECT CAST(unnest(generate_series(CAST(first_dt AS TIMESTAMP), CAST(last_dt AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS calendar_dt FROM date_bounds",
    "calendar": f"SELECT calendar_dt, {sql_week('calendar_dt')} AS week_id, {sql_month('calendar_dt')} AS month_id FROM calendar_days",
    "shipments": f"SELECT l_orderkey, l_linenumber, l_quantity, {sql_week(SHIP)} AS week_id, {sql_month(SHIP)} AS month_id FROM lineitem",
    "claims": f"""SELECT l_orderkey AS claim_id, l_linenumber AS svc_nbr, CAST(round(l_tax * 100) AS INT) AS diag_cd_posn_nbr,
        l_partkey AS ndc, p_brand AS prc_cd, p_type AS diag_cd, CASE WHEN p_size > 25 THEN 10 ELSE 9 END AS diag_vers_typ_id,
        o_custkey AS patient_id, l_suppkey AS pharmacy_id, l_extendedprice AS svc_crgd_amt, {SHIP} AS svc_dt, {ORDERED} AS order_dt,
        l_returnflag, l_linestatus, {sql_week(SHIP)} AS week_id, {sql_month(SHIP)} AS month_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "month_weeks": "SELECT month_id, min(week_id) AS begin_week_id, max(week_id) AS end_week_id FROM calendar GROUP BY month_id",
    "in_months": "SELECT c.* FROM claims c JOIN month_weeks m ON c.month_id = m.month_id AND c.week_id BETWEEN m.begin_week_id AND m.end_week_id",
    "weekly_panel": f"SELECT l_suppkey AS pharmacy_id, {sql_week(SHIP)} AS week_id, CASE WHEN sum(l_quantity) >= 25 THEN 1 ELSE 0 END AS pat_actn_ind FROM lineitem GROUP BY 1, 2",
    "overrides": "SELECT s_suppkey AS pharmacy_id, 19960101 AS start_week_id, 20001231 AS end_week_id FROM supplier WHERE s_acctbal < 500",
    "unit_dimension": """SELECT s_suppkey AS pharmacy_id, CASE WHEN s_nationkey < 7 THEN ' R' WHEN s_nationkey < 13 THEN 'M' WHEN s_nationkey < 19 THEN 'L ' END AS chnl_cd,
        CASE WHEN s_acctbal > 5000 THEN 'AB' ELSE 'C' END AS store_typ_cd FROM supplier WHERE s_acctbal < 9000""",
    "patient_data": "SELECT DISTINCT o_custkey AS patient_id, l_suppkey AS pharmacy_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "weeks_refreshed": f"SELECT DISTINCT {sql_week(SHIP)} AS week_id, CASE WHEN {sql_week(SHIP)} <= (SELECT max({sql_week(ORDERED)}) FROM orders) THEN 1 ELSE 0 END AS data_refresh_ind FROM lineitem",
    "scores": """SELECT 'quality' AS model, quality AS y_true, n_chars AS score FROM labels JOIN documents USING (doc_id)
        UNION ALL SELECT 'toxic', toxic, n_chars FROM labels JOIN documents USING (doc_id)""",
    "score_groups": "SELECT model, score AS threshold, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM scores GROUP BY model, score",
    "score_table": """SELECT *, sum(tp) OVER w AS cum_tp, sum(fp) OVER w AS cum_fp, sum(tp) OVER (PARTITION BY model) AS all_tp, sum(fp) OVER (PARTITION BY model) AS all_fp,
        lead(tp) OVER (PARTITION BY model ORDER BY threshold DESC) AS next_tp, lead(fp) OVER (PARTITION BY model ORDER BY threshold DESC) AS next_fp
        FROM score_groups WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)""",
    "texts": "SELECT doc_id, string_split(translate(text, ' ' || chr(10), '||'), '|') AS words FROM documents",
    "word_tokens": "SELECT doc_id, pos, token FROM (SELECT doc_id, unnest(words) AS raw, lower(unnest(words)) AS token, generate_subscripts(words, 1) AS pos FROM texts) WHERE token <> ''",
    "word_vocab": "SELECT token, n, row_number() OVER (ORDER BY n DESC, f) AS idx FROM (SELECT token, count(*) AS n, min(doc_id * 10000000 + pos) AS f FROM word_tokens GROUP BY token)",
}

# Roles each role reads.
_NEEDS = {
    "calendar_days": ["date_bounds"],
    "calendar": ["calendar_days"],
    "month_weeks": ["calendar"],
    "in_months": ["claims", "month_weeks"],
    "score_groups": ["scores"],
    "score_table": ["score_groups"],
    "word_tokens": ["texts"],
    "word_vocab": ["word_tokens"],
}


def with_roles(*names: str, **extra: str) -> str:
    """A WITH clause that defines the roles and whatever they read, then the extra views."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in chosen:
            chosen.append(name)

    for name in names:
        add(name)
    views = [f"{n} AS ({_ROLES[n]})" for n in chosen] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(views) + "\n"
