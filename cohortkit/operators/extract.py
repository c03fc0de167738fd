"""Extraction of claims from three feeds by a list of codes, products or patients.

The gap feed already carries every output column. The main feed lacks some of them; these come from the
enrichment feed by a left join. All three feeds are cut to the requested months and to the list first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortkit.functions import calendar as cal
from cohortkit.functions import sketches


@dataclass(frozen=True)
class Domain:
    """How the main feed meets the enrichment feed.

    ``join_keys`` identify a record; ``load_date`` is the output column taken from the enrichment feed,
    or else from ``main_load_date``; ``renamed`` maps output columns to SQL expressions over the
    enrichment feed, for history columns whose plain name also exists in the main feed. Every other
    output column the main feed lacks is read from the enrichment feed under its own name.
    """

    join_keys: tuple[str, ...]
    load_date: str
    main_load_date: str
    renamed: Mapping[str, str] = field(default_factory=dict)


# Record keys of the two claim domains.
DIAGNOSIS_KEYS = ("claim_id", "diag_cd_posn_nbr", "svc_nbr")
PRESCRIPTION_KEYS = ("claim_id",)

# List columns of the five extractions.
BY_DIAGNOSIS = ("diag_cd", "diag_vers_typ_id")
BY_PROCEDURE = ("prc_cd",)
BY_PRODUCT = ("ndc",)
BY_PATIENT = ("patient_id",)


def _broadcast_limit(spark) -> int:
    told = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if told.lstrip("-").isdigit():
        return int(told)
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told))


def list_bits(key_list: DataFrame, keys: Sequence[str], feed: DataFrame) -> DataFrame | None:
    """Bits of a list that is too large to broadcast, for :func:`filter_by_keys`; None where Spark broadcasts it.

    Also None if the list's columns have other types than the feed's, as then equal keys need not hash alike.
    """
    types, own = dict(key_list.dtypes), dict(feed.dtypes)
    if any(types[k] != own[k] for k in keys) or sketches.estimated_bytes(key_list.select(*keys)) <= _broadcast_limit(key_list.sparkSession):
        return None
    return sketches.key_bits(key_list, keys)


def filter_by_keys(feed: DataFrame, key_list: DataFrame, keys: Sequence[str], bits: DataFrame | None = None) -> DataFrame:
    """Rows whose keys are in the list. Repeated list entries do not repeat rows.

    With ``bits`` (see :func:`list_bits`) the scan drops rows whose key is certainly not listed, so that the
    exact join shuffles little more than the rows it keeps.
    """
    rows = feed
    if bits is not None:
        rows = sketches.with_maybe(feed, bits, keys).where("_maybe").drop("_maybe")
    return rows.join(key_list.select(*keys).distinct(), list(keys), "left_semi").select(*feed.columns)


def month_bounds(calendar: DataFrame, month_from: int, month_to: int) -> list[Row]:
    """First and last week of every month in the range, read once: at most one row per month."""
    return cal.month_week_bounds(calendar, month_from, month_to).collect()


def cut_to_months(feed: DataFrame, bounds: Sequence[Row], month_from: int, month_to: int) -> DataFrame:
    """Rows of the months in the range whose week lies in the bounds of their month.

    The month and week ranges are plain filters on literals, so feeds partitioned by either key are pruned
    when the query is planned; the side with one row per month is local.
    """
    if not bounds:
        return feed.where(F.lit(False))
    weeks = feed.sparkSession.createDataFrame([(r.month_id, r.begin_week_id, r.end_week_id) for r in bounds], "_month int, _begin int, _end int")
    inside = F.col("week_id").between(min(r.begin_week_id for r in bounds), max(r.end_week_id for r in bounds))
    return (
        feed.where(F.col("month_id").between(int(month_from), int(month_to)) & inside)
        .join(F.broadcast(weeks), (F.col("month_id") == F.col("_month")) & F.col("week_id").between(F.col("_begin"), F.col("_end")), "left_semi")
    )


def in_months(feed: DataFrame, calendar: DataFrame, month_from: int, month_to: int) -> DataFrame:
    """Rows of the months in the range whose week is one of their month's weeks. Reads the calendar when called."""
    return cut_to_months(feed, month_bounds(calendar, month_from, month_to), month_from, month_to)


def enrich(main: DataFrame, enrichment: DataFrame, columns: Sequence[str], domain: Domain) -> DataFrame:
    """The output columns for the main feed. Several different matches repeat the row.

    Equal enrichment rows are merged before the join: they could only produce equal output rows, and a
    record with many copies in both feeds would otherwise be paired copy by copy.
    """
    keys = [*domain.join_keys, "month_id"]
    own = {c.lower() for c in main.columns}
    taken: dict[str, str] = {domain.load_date: domain.load_date}
    for name in columns:
        if name.lower() not in own and name != domain.load_date:
            taken[name] = domain.renamed.get(name, name)
    added = enrichment.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.expr(e).alias(f"_new_{n}") for n, e in taken.items()]
    ).distinct()
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_key_{k}"))
    output = []
    for name in columns:
        if name == domain.load_date:
            output.append(F.coalesce(f"_new_{name}", domain.main_load_date).alias(name))
        else:
            output.append(F.col(f"_new_{name}").alias(name) if name in taken else F.col(name))
    return main.join(added, match, "left").select(*output)


def _merged_by_month(claims: DataFrame, months: int) -> DataFrame:
    """``dropDuplicates`` whose shuffle deals the rows of a month into parts by their hash: four for each shuffle partition in all."""
    parts = max(1, -(-4 * int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, months)))
    dealt = claims.withColumn("_part", F.pmod(F.xxhash64(*claims.columns), F.lit(parts)))
    # Equal rows share their month and part, so merging them needs no shuffle after this one.
    return dealt.repartition("month_id", "_part").dropDuplicates().drop("_part")


def extract_claims(
    gap: DataFrame,
    main: DataFrame,
    enrichment: DataFrame,
    key_list: DataFrame,
    keys: Sequence[str],
    domain: Domain,
    calendar: DataFrame,
    month_from: int,
    month_to: int,
    columns_out: Sequence[str] | None = None,
    by_month: bool = False,
) -> DataFrame:
    """Claims of the listed keys in the months, without repeated rows, then cut to ``columns_out``.

    ``columns_out`` are columns or SQL expressions; they are applied after equal rows are merged, so
    they may bring equal rows back. With ``by_month`` the shuffle that merges equal rows deals them out by month
    too, so that a table by month may be written without another one (see ``collect.store_extract``).
    """
    columns = gap.columns
    bounds = month_bounds(calendar, month_from, month_to)
    gap, main, enrichment = (
        filter_by_keys(cut_to_months(feed, bounds, month_from, month_to), key_list, keys, list_bits(key_list, keys, feed)) for feed in (gap, main, enrichment)
    )
    claims = gap.unionByName(enrich(main, enrichment, columns, domain))
    claims = _merged_by_month(claims, len(bounds)) if by_month else claims.dropDuplicates()
    return claims if columns_out is None else claims.selectExpr(*columns_out)


def dx_by_diagnosis(gap, main, enrichment, diag_list, domain, calendar, month_from, month_to, columns_out=None, by_month=False) -> DataFrame:
    return extract_claims(gap, main, enrichment, diag_list, BY_DIAGNOSIS, domain, calendar, month_from, month_to, columns_out, by_month)


def dx_by_procedure(gap, main, enrichment, proc_list, domain, calendar, month_from, month_to, columns_out=None, by_month=False) -> DataFrame:
    return extract_claims(gap, main, enrichment, proc_list, BY_PROCEDURE, domain, calendar, month_from, month_to, columns_out, by_month)


def dx_by_patient(gap, main, enrichment, patient_list, domain, calendar, month_from, month_to, columns_out=None, by_month=False) -> DataFrame:
    return extract_claims(gap, main, enrichment, patient_list, BY_PATIENT, domain, calendar, month_from, month_to, columns_out, by_month)


def rx_by_product(gap, main, enrichment, ndc_list, domain, calendar, month_from, month_to, columns_out=None, by_month=False) -> DataFrame:
    return extract_claims(gap, main, enrichment, ndc_list, BY_PRODUCT, domain, calendar, month_from, month_to, columns_out, by_month)


def rx_by_patient(gap, main, enrichment, patient_list, domain, calendar, month_from, month_to, columns_out=None, by_month=False) -> DataFrame:
    return extract_claims(gap, main, enrichment, patient_list, BY_PATIENT, domain, calendar, month_from, month_to, columns_out, by_month)
