import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortkit.functions import calendar as cal
from cohortkit.operators import panel
from cohortkit.plans import bindings as b

START, END = 200001, 200003
WEEKS = [r for r in (20000107, 20000114, 20000121, 20000128, 20000204, 20000211, 20000218, 20000225, 20000303, 20000310, 20000317, 20000324, 20000331)]


def weekly(spark, rows):
    return spark.createDataFrame(rows, "pharmacy_id long, week_id int, pat_actn_ind int")


def active(spark, spans):
    return weekly(spark, [(unit, w, 1) for unit, n in spans.items() for w in WEEKS[:n]])


def units(df):
    return sorted(r.pharmacy_id for r in df.collect())


def test_threshold_is_floored(spark, year2000):
    data = active(spark, {1: 11, 2: 10})
    assert units(panel.stable_units(data, year2000, START, END, time_share=90)) == [1]


def test_share_zero_needs_an_active_week(spark, year2000):
    data = weekly(spark, [(1, WEEKS[0], 1), (2, WEEKS[0], 0)])
    assert units(panel.stable_units(data, year2000, START, END, time_share=0)) == [1]
    assert units(panel.stable_units(data, year2000, START, END, time_share=-5)) == [1]


def test_share_above_100_means_100(spark, year2000):
    data = active(spark, {1: 13, 2: 12})
    assert units(panel.stable_units(data, year2000, START, END, time_share=150)) == [1]
    assert units(panel.stable_units(data, year2000, START, END, time_share=None)) == [1]
    with pytest.raises(ValueError):
        panel.stable_units(data, year2000, START, END, time_share="most")


def test_override_week_counts_once(spark, year2000):
    overrides = spark.createDataFrame([(1, WEEKS[0], WEEKS[12]), (3, 19990101, 20011231), (4, None, 20000201)], "pharmacy_id long, start_week_id int, end_week_id int")
    got = panel.stable_units(active(spark, {1: 5, 2: 5}), year2000, START, END, overrides=overrides)
    assert sorted((r.pharmacy_id, r.elig_period_cnt) for r in got.collect()) == [(1, 13), (3, 13)]


def test_attributes_and_constants(spark, year2000):
    dimension = spark.createDataFrame([(1, None, "abc"), (2, " R", "x")], "pharmacy_id long, chnl_cd string, store_typ_cd string")
    got = panel.stable_units(active(spark, {1: 13, 2: 13, 3: 13}), year2000, END, START, dimension=dimension)
    first, last = dt.date(2000, 1, 1), dt.date(2000, 3, 31)
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 13, "z", "a", first, last, 200001),
        (2, 13, "R", "x", first, last, 200001),
        (3, 13, "z", "z", first, last, 200001),
    ]
    assert {r.cohort_id for r in panel.stable_units(active(spark, {1: 13}), year2000, START, END, cohort="7").collect()} == {7}


def test_dimension_with_repeated_keys_fans_out(spark, year2000):
    dimension = spark.createDataFrame([(1, "A", "x"), (1, "B", "x")], "pharmacy_id long, chnl_cd string, store_typ_cd string")
    got = panel.stable_units(active(spark, {1: 13}), year2000, START, END, dimension=dimension)
    assert sorted(r.chnl_cd for r in got.collect()) == ["A", "B"]


def test_bulk_equals_one_by_one(spark, year2000):
    data = active(spark, {1: 13, 2: 9, 3: 4, 4: 1}).unionByName(weekly(spark, [(5, 20000102, 1), (5, WEEKS[3], 1), (6, WEEKS[5], 0)]))
    overrides = spark.createDataFrame([(3, 20000115, 20000310)], "pharmacy_id long, start_week_id int, end_week_id int")
    cohorts = spark.createDataFrame([(1, 200003, 200001), (2, 200002, 200002), (3, 200001, 200003), (4, 20000115, 1999)], "cohort int, start int, lookback int")
    bulk = panel.stable_units_bulk(data, year2000, cohorts, overrides, None, 50)
    single = [
        panel.stable_units(data, year2000, c.lookback, c.start, c.cohort, overrides, None, 50) for c in cohorts.collect()
    ]
    want = sorted(tuple(r) for s in single for r in s.collect())
    assert sorted(tuple(r) for r in bulk.collect()) == want and len(want) > 4


def test_bulk_windows_that_share_a_cohort(spark, year2000):
    data = active(spark, {1: 13})
    local = pd.DataFrame({"cohort": [1, 1, 2, 2], "start": [200001, 200002, 200003, 200003], "lookback": [200001, 200002, 200001, 200001]})
    got = panel.stable_units_bulk(data, year2000, local)
    want = [panel.stable_units(data, year2000, r.lookback, r.start, r.cohort).collect() for r in local.drop_duplicates().itertuples()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for rows in want for r in rows) and got.count() == 3
    with pytest.raises(TypeError):
        panel.stable_units_bulk(data, year2000, [1])


def test_overlapping_nested_and_open_overrides(spark, year2000):
    spans = [(1, 20000101, 20000204), (1, 20000120, 20000310), (1, 20000121, 20000125), (2, 20000310, 20000310), (2, 20000310, 20000310), (3, None, 20000331)]
    spans += [(4, 20000331, 20000107), (5, 19990101, 20000106), (6, 20000109, 20000113), (7, 20000332, 20010101), (None, 20000107, 20000114)]
    data = spark.createDataFrame(spans, "pharmacy_id long, start_week_id int, end_week_id int")
    got = panel.expand_intervals(data, year2000, 20000107, 20000331)
    want = {(u, w) for u, a, z in spans for w in WEEKS if a is not None and z is not None and a <= w <= z}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert dict(got.dtypes)["week_id"] == dict(year2000.dtypes)["week_id"]
    assert panel.expand_intervals(data, year2000, 20500107, 20500331).count() == 0


def test_bulk_with_more_windows_than_one_word_holds(spark, year2000):
    dice = random.Random(9)
    weeks = sorted(r.week_id for r in year2000.select("week_id").distinct().collect())
    rows = [(u, w, int(dice.random() < 0.4 + u / 20)) for u in range(8) for w in weeks] + [(9, 20000102, 1), (None, weeks[3], 1)]
    cohorts = pd.DataFrame([(n, 200001 + n % 12, 199901 + n % 11) for n in range(70)], columns=["cohort", "start", "lookback"])
    data = spark.createDataFrame(rows, "pharmacy_id long, week_id int, pat_actn_ind int")
    got = {(r.pharmacy_id, r.cohort_id): r.elig_period_cnt for r in panel.stable_units_bulk(data, year2000, cohorts, time_share=60).collect()}
    want = {}
    for c in cohorts.itertuples():
        span = [w for w in weeks if cal.week_key(cal.period_start(c.lookback)) <= w <= cal.week_key(cal.period_end(c.start))]
        for u in {r[0] for r in rows}:
            n = len({w for x, w, on in rows if x == u and on and w in span})
            if n and n >= len(span) * 60 // 100:
                want[u, c.cohort] = n
    assert got == want and len(want) > 100


def test_bulk_patients_against_brute_force(spark, year2000):
    dice = random.Random(4)
    cohorts = [(n, 200001 + n % 12, 200001 + n % 12 - (n % 3 if n % 12 >= 2 else 0)) for n in range(66)]
    windows = panel.Windows(spark, spark.createDataFrame(cohorts, "cohort int, start int, lookback int"), year2000)
    dates = {n: (cal.period_start(back), cal.period_end(start)) for n, start, back in cohorts}
    listed = [(u, chr(65 + u % 3), n, *dates[n]) for u in range(6) for n in dates if dice.random() < 0.8]
    units = spark.createDataFrame(listed, "pharmacy_id long, chnl_cd string, cohort_id long, stable_period_start date, stable_period_end date")
    seen = [(dice.choice("abcdefg"), dice.choice([0, 1, 2, 3, 4, 5]), dice.choice(WEEKS)) for _ in range(60)] + [("z", None, WEEKS[0]), (None, 1, WEEKS[0]), ("y", 1, 20000102)]
    data = spark.createDataFrame(seen, "patient_id string, pharmacy_id long, week_id int")
    want = set()
    inside = {(u, n): c for u, c, n, *_ in listed}
    for n, (a, z) in dates.items():
        used = {}
        for p, u, w in seen:
            if p is not None and w in WEEKS and cal.week_key(a) <= w <= cal.week_key(z):
                used.setdefault(p, set()).add(u)
        want |= {(n, p, a, z, tuple(sorted({inside[u, n] for u in us}))) for p, us in used.items() if all((u, n) in inside for u in us)}
    got = {(r.cohort_id, r.patient_id, r.stable_period_start, r.stable_period_end, tuple(r.cnls_cds)) for r in panel.stable_patients_bulk(data, units, year2000, windows).collect()}
    assert got == want and len(want) > 50
    none = panel.Windows(spark, spark.createDataFrame([], "cohort int, start int, lookback int"), year2000)
    assert panel.stable_patients_bulk(data, units, year2000, none).count() == 0


def test_patients_come_back_for_every_cohort(spark):
    two = _panel(spark).unionByName(_panel(spark, ("R",)).withColumn("cohort_id", F.lit(2).cast("long")))
    data = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("c", 9)], "patient_id string, pharmacy_id long")
    got = {(r.cohort_id, r.patient_id) for r in panel.stable_patients(data, two).collect()}
    assert got == {(1, "a"), (2, "a"), (1, "b")}


def test_stable_units_match_known_counts(spark):
    """Counts for three months of shipments, with every tenth supplier overridden."""
    d = "/root/testdata/sf0.01"
    overrides = b.table(spark, d, "supplier").where("s_suppkey % 10 = 0").selectExpr(
        "s_suppkey as pharmacy_id", "20000101 as start_week_id", "20000630 as end_week_id"
    )
    weeks, days = b.weekly_panel(spark, d).cache(), cal.build_calendar(spark, 1995, 2001)
    counts = [panel.stable_units(weeks, days, START, END, overrides=overrides, time_share=s).count() for s in (100, 80, 70, 60)]
    weeks.unpersist()
    assert counts == [10, 32, 47, 88]


def _panel(spark, channels=("R", "M")):
    rows = [(i + 1, c, 1) for i, c in enumerate(channels)]
    return spark.createDataFrame(rows, "pharmacy_id long, chnl_cd string, cohort_id long").selectExpr(
        "*", "date'2000-01-01' as stable_period_start", "date'2000-03-31' as stable_period_end"
    )


def test_stable_patients(spark):
    data = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 3), ("c", None), (None, 1), (None, 9)], "patient_id string, pharmacy_id long"
    )
    got = sorted(((r.cohort_id, r.patient_id, r.cnls_cds) for r in panel.stable_patients(data, _panel(spark)).collect()), key=repr)
    assert got == sorted([(1, "a", ["M", "R"]), (1, None, ["R"]), (None, None, [])], key=repr)


def test_channels_once(spark):
    data = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "patient_id string, pharmacy_id long").withColumn("cohort_id", F.lit(99))
    got = panel.stable_patients(data, _panel(spark, ("R", "M", "M"))).collect()
    assert [(r.cohort_id, r.cnls_cds) for r in got] == [(1, ["M", "R"])]


def test_patients_judged_by_their_cohort(spark):
    two = _panel(spark, ("R",)).unionByName(_panel(spark, ("R", "M")).withColumn("cohort_id", F.lit(2).cast("long")))
    data = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 1, 2), ("a", 2, 2)], "patient_id string, pharmacy_id long, cohort_id long")
    got = panel.stable_patients(data, two, by_cohort=True).collect()
    assert [(r.cohort_id, r.patient_id, r.cnls_cds) for r in got] == [(2, "a", ["M", "R"])]


def test_stable_patients_against_brute_force(spark):
    dice = random.Random(11)
    pairs = [(dice.choice([None, *"abcdefgh"]), dice.choice([None, 1, 1, 1, 2, 2, 3])) for _ in range(60)]
    members = {1: "R", 2: "M"}
    want = set()
    unstable = {p for p, u in pairs if u not in members}
    for p in {p for p, _ in pairs if p is not None} - unstable:
        want.add((1, p, tuple(sorted({members[u] for q, u in pairs if q == p}))))
    nobody = [u for p, u in pairs if p is None]
    want |= {(1, None, tuple(sorted({members[u] for u in nobody if u in members})))} if any(u in members for u in nobody) else set()
    want |= {(None, None, ())} if any(u not in members for u in nobody) else set()
    data = spark.createDataFrame(pairs, "patient_id string, pharmacy_id long")
    got = {(r.cohort_id, r.patient_id, tuple(r.cnls_cds)) for r in panel.stable_patients(data, _panel(spark)).collect()}
    assert got == want


def test_eligible_patients(spark):
    people = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x")], "patient_id long, tag string")
    starts = spark.createDataFrame([(1, "1999-01-01"), (1, "1998-01-01"), (2, "2000-01-01"), (3, "1999-12-31"), (4, "1999-01-01")], "patient_id long, d string")
    starts = starts.select("patient_id", F.to_timestamp("d").alias("pat_strt_dt_rx"))
    activity = spark.createDataFrame([(1, 200001), (1, 200002), (2, 200001), (3, 199911), (4, 200004)], "patient_id long, month_id int")
    ids = lambda df: sorted(r.patient_id for r in df.collect())
    assert ids(panel.eligible_patients(people, starts, activity, start=2000)) == [1, 3, 4]
    assert ids(panel.eligible_patients(people, starts, activity, end=200002)) == [1, 2]
    assert ids(panel.eligible_patients(people, starts, activity, start=2000, end=200002)) == [1]
    assert ids(panel.eligible_patients(people, starts, activity)) == [1, 2, 3, 4]
    assert panel.eligible_patients(people, starts, activity, start=2000).columns == ["patient_id", "tag"]


def test_more_share_fewer_units(spark, year2000):
    data = active(spark, {i: i for i in range(1, 14)})
    counts = [panel.stable_units(data, year2000, START, END, time_share=s).count() for s in (0, 25, 50, 75, 100)]
    assert counts == sorted(counts, reverse=True) and counts[-1] == 1
