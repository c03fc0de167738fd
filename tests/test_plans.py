"""Plan shapes that matter at scale: pruning, pushdown, skew splitting, shuffles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import extract, panel
from cohortkit.plans import bindings as b
from cohortkit.plans.queries import QUERIES
from cohortkit.sources import writers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    changed = {}

    def set_(**values):
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            changed.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield set_
    for name, value in changed.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_months_prune_partitions(spark, year2000):
    name = "t.pruned"
    rows = spark.createDataFrame([(1, 20000107, 200001), (2, 20000211, 200002)], "id long, week_id int, month_id int")
    writers.save_table(rows, name, "month_id")
    text = plan(extract.in_months(spark.table(name), year2000, 200001, 200001))
    filters = next(line for line in text.splitlines() if "PartitionFilters" in line)
    assert "month_id" in filters.split("PartitionFilters")[1] and "200001" in filters.split("PartitionFilters")[1]


def test_months_prune_week_partitions(spark, year2000):
    rows = spark.createDataFrame([(1, 200001, 20000107), (2, 200002, 20000211)], "id long, month_id int, week_id int")
    writers.save_table(rows, "t.pruned_weeks", "week_id")
    got = extract.in_months(spark.table("t.pruned_weeks"), year2000, 200001, 200001)
    assert [r.id for r in got.collect()] == [1]
    scan = next(line for line in plan(got).splitlines() if "pruned_weeks" in line)
    assert "week_id" in scan.split("PartitionFilters")[1].split("]")[0]


def test_bulk_panel_prunes_weeks(spark, year2000):
    rows = spark.createDataFrame([(1, 1, 20000107), (2, 1, 20010209)], "pharmacy_id long, pat_actn_ind int, week_id int")
    writers.save_table(rows, "t.weekly_parts", "week_id")
    cohorts = spark.createDataFrame([(1, 200003, 200001)], "cohort int, start int, lookback int")
    got = panel.stable_units_bulk(spark.table("t.weekly_parts"), year2000, cohorts, time_share=1)
    assert [r.pharmacy_id for r in got.collect()] == [1]
    scan = next(line for line in plan(got).splitlines() if "weekly_parts" in line)
    assert "week_id" in scan.split("PartitionFilters")[1].split("]")[0]


def test_bulk_panel_shuffles_units_once(spark, year2000):
    """One row per unit leaves the only shuffle, however many windows there are."""
    rows = spark.range(5).repartition(3).selectExpr("id as pharmacy_id", "case when id < 0 then 20000114 else 20000107 end as week_id", "1 as pat_actn_ind")
    cohorts = [(1, 200003, 200001), (2, 200004, 200001), (3, 200012, 200001), (4, 200006, 200006)]
    shuffled = []
    for n in (1, 4):
        given = spark.createDataFrame(cohorts[:n], "cohort int, start int, lookback int")
        text = plan(panel.stable_units_bulk(rows, year2000, given, time_share=1))
        exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert len(exchanges) == 1 and "pharmacy_id" in exchanges[0]
        assert not any(x in text for x in ("Cartesian", "NestedLoop", "Python"))
        shuffled.append(exchanges[0].split("[plan_id")[0])
    assert "Generate" not in text.split("Exchange hashpartitioning")[1]


def test_bulk_patients_hold_no_row_per_cohort(spark, year2000):
    """Generators only list channels and, at the end, the windows of a patient that stays."""
    cohorts = panel.Windows(spark, spark.createDataFrame([(1, 200003, 200001), (2, 200006, 200004)], "cohort int, start int, lookback int"), year2000)
    weekly = spark.range(5).repartition(3).selectExpr("id as pharmacy_id", "case when id < 0 then 20000114 else 20000107 end as week_id", "1 as pat_actn_ind")
    units = panel.stable_units_bulk(weekly, year2000, cohorts, time_share=1)
    people = spark.range(50).repartition(3).selectExpr("id as patient_id", "id % 5 as pharmacy_id", "case when id < 0 then 20000114 else 20000107 end as week_id")
    text = plan(panel.stable_patients_bulk(people, units, year2000, cohorts))
    assert not any(x in text for x in ("Cartesian", "NestedLoop", "Python"))
    assert not any("cohort_id" in line for line in text.splitlines() if "hashpartitioning(patient_id" in line)


def test_feeds_read_only_their_columns_and_push_filters(spark):
    text = plan(b.gap_feed(spark, SF).select("claim_id", "svc_crgd_amt"))
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "EqualTo(l_returnflag,A)" in scan and "l_discount" not in scan.split("ReadSchema")[1]


def test_hot_record_is_split(spark, conf, year2000):
    """A third of the rows share one record key; the enrichment join splits them over tasks."""
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="64KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB",
        adaptive__skewJoin__skewedPartitionFactor="2.0",
        adaptive__coalescePartitions__enabled="false",
        shuffle__partitions="8",
    )
    day = dt.date(2000, 1, 10)
    base = spark.range(30000, numPartitions=6).selectExpr(
        "case when id % 3 = 0 then 1 else id end as claim_id", "1 as svc_nbr", "1 as diag_cd_posn_nbr", "'A' as diag_cd", "9 as diag_vers_typ_id",
        "sha2(string(id), 256) as note", "20000114 as week_id", "200001 as month_id",
    )
    main = base.withColumn("main_load_dt", F.lit(day))
    added = base.withColumn("load_dt", F.lit(day)).withColumn("pat_age_yr_nbr", F.lit(5))
    columns = [*base.columns[:-2], "load_dt", "pat_age_yr_nbr", "week_id", "month_id"]
    joined = extract.enrich(main, added, columns, b.DIAGNOSIS).groupBy("diag_cd").agg(F.count(F.lit(1)).alias("n"), F.max("note"))
    assert [r.n for r in joined.collect()] == [30000]
    text = plan(joined)
    assert "skew=true" in text or "skewed" in text


def test_a_large_list_filters_the_scans(spark, conf):
    """With broadcasts of the list off, a table of bits of fixed size drops rows before the exact join's shuffle."""
    before = sorted(map(tuple, QUERIES["extract_by_patient"](spark, SF).collect()))
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    got = QUERIES["extract_by_patient"](spark, SF)
    assert sorted(map(tuple, got.collect())) == before and before
    text = plan(got)
    assert text.count("getbit") >= 3 and "LeftSemi" in text
    for part in text.split("LeftSemi")[1:4]:
        assert "bit_or" in part or "getbit" in part or "_bits" in part


def test_an_exact_list_decides(spark, conf):
    """Keys that share a slot with listed ones are dropped by the join."""
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    feed = spark.range(20000).selectExpr("id", "id % 500 as patient_id")
    listed = spark.range(0, 500, 7).selectExpr("id as patient_id").union(spark.range(3).selectExpr("cast(null as bigint)"))
    bits = extract.list_bits(listed, ["patient_id"], feed)
    assert bits is not None and extract.list_bits(listed.selectExpr("cast(patient_id as int) as patient_id"), ["patient_id"], feed) is None
    got = extract.filter_by_keys(feed, listed, ["patient_id"], bits)
    assert {r.patient_id for r in got.select("patient_id").distinct().collect()} == set(range(0, 500, 7)) and got.count() == 40 * 72


@pytest.mark.parametrize("name", ["extract_by_code_pair", "panel_stable_units", "panel_stable_patients", "panel_stable_units_bulk", "panel_stable_patients_bulk", "vector_topk", "text_chunks", "corr_matrix", "search_keywords"])
def test_no_python_in_the_plan(spark, name):
    assert "Python" not in plan(QUERIES[name](spark, SF))
