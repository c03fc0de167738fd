import datetime as dt
import random

import pytest

from cohortkit.operators import extract
from cohortkit.plans import bindings as b
from cohortkit.plans import collect
from cohortkit.sources import writers

GAP = "claim_id long, svc_nbr int, diag_cd_posn_nbr int, diag_cd string, diag_vers_typ_id int, patient_id long, note string, load_dt date, pat_age_yr_nbr int, week_id int, month_id int"
MAIN = GAP.replace("load_dt date, pat_age_yr_nbr int", "main_load_dt date")
W, M = 20000114, 200001
OLD, NEW = dt.date(2001, 1, 1), dt.date(2002, 2, 2)


def gap_row(claim, note="g", code="A", week=W, month=M):
    return (claim, 1, 1, code, 9, 7, note, OLD, 40, week, month)


def main_row(claim, note="m", code="A", week=W, month=M, patient=7):
    return (claim, 1, 1, code, 9, patient, note, OLD, week, month)


def added_row(claim, age=50, code="A", month=M, week=W):
    return (claim, 1, 1, code, 9, 7, "e", NEW, age, week, month)


@pytest.fixture
def run(spark, year2000):
    def extracted(gap, main, added, codes=(("A", 9),), out=None, by=extract.dx_by_diagnosis, first=M, last=M, **more):
        frames = spark.createDataFrame(gap, GAP), spark.createDataFrame(main, MAIN), spark.createDataFrame(added, GAP)
        keys = spark.createDataFrame(list(codes), "diag_cd string, diag_vers_typ_id int" if by is extract.dx_by_diagnosis else "patient_id long")
        return by(*frames, keys, b.DIAGNOSIS, year2000, first, last, out, **more)

    return extracted


def test_list_entries_do_not_multiply(run):
    assert run([gap_row(1)], [main_row(2)], [], codes=[("A", 9), ("A", 9), ("B", 9)]).count() == 2
    assert run([gap_row(1)], [main_row(2)], [], codes=[("A", 10)]).count() == 0


def test_load_date_and_age(run):
    got = {r.claim_id: (r.load_dt, r.pat_age_yr_nbr) for r in run([gap_row(1)], [main_row(2), main_row(3)], [added_row(3)]).collect()}
    assert got == {1: (OLD, 40), 2: (OLD, None), 3: (NEW, 50)}


def test_fan_out(run):
    assert run([], [main_row(1)], [added_row(1, 50), added_row(1, 51)]).count() == 2
    assert run([], [main_row(1)], [added_row(1, 50), added_row(1, 50)]).count() == 1


def test_enrichment_is_cut_by_its_own_code(run):
    got = run([], [main_row(1)], [added_row(1, code="B")]).collect()
    assert [(r.load_dt, r.pat_age_yr_nbr) for r in got] == [(OLD, None)]


def test_enrichment_of_another_month_does_not_match(run):
    got = run([], [main_row(1)], [added_row(1, month=200002, week=20000211)], last=200002).collect()
    assert [r.pat_age_yr_nbr for r in got] == [None]


def test_projection_after_dedupe(run):
    out = ["claim_id", "upper(diag_cd) as code", "month_id"]
    got = run([gap_row(1, "x"), gap_row(1, "y"), gap_row(1, "y")], [], [], out=out)
    assert [tuple(r) for r in got.collect()] == [(1, "A", M)] * 2


def test_week_bounds(run):
    kept = [gap_row(1, week=20000107), gap_row(2, week=20000204)]
    lost = [gap_row(3, week=20000211), gap_row(4, week=None), gap_row(5, month=200002, week=20000211), gap_row(6, month=None)]
    assert sorted(r.claim_id for r in run(kept + lost, [], []).collect()) == [1, 2]


def test_all_patients_equal_the_unfiltered_feed(run):
    main = [main_row(i, patient=i % 3) for i in range(9)]
    got = run([], main, [], codes=[(0,), (1,), (2,)], by=extract.dx_by_patient)
    assert sorted(r.claim_id for r in got.collect()) == list(range(9))


def test_prescription_history_columns(spark, year2000):
    gap = spark.createDataFrame([], "claim_id long, ndc string, payer_id int, load_dt date, payer_hist_id int, plan_hist_id int, week_id int, month_id int")
    main = spark.createDataFrame([(1, "n", 5, OLD, W, M)], "claim_id long, ndc string, payer_id int, main_load_dt date, week_id int, month_id int")
    added = spark.createDataFrame([(1, "n", 6, "77", None, W, M)], "claim_id long, ndc string, payer_id int, plan_id string, load_dt date, week_id int, month_id int")
    keys = spark.createDataFrame([("n",)], "ndc string")
    got = extract.rx_by_product(gap, main, added, keys, b.PRESCRIPTION, year2000, M, M).collect()
    assert [tuple(r) for r in got] == [(1, "n", 5, OLD, 6, 77, W, M)]


def test_store_extract_replaces_its_months(spark, run, year2000, rows):
    out = ["claim_id", "month_id"]
    first = [gap_row(1), gap_row(2, month=200002, week=20000211)]
    collect.store_extract(run(first, [], [], out=out, last=200002), "t.claims", year2000, M, 200002)
    again = collect.store_extract(run([gap_row(3)], [], [], out=out, last=200001), "t.claims", year2000, M, M, method="append")
    assert rows(again) == [(2, 200002), (3, M)]
    with pytest.raises(ValueError):
        collect.store_extract(again, "t.claims", year2000, M, M, method="MERGE")


def test_extract_by_month_is_stored_without_another_shuffle(spark, run, year2000, rows, monkeypatch):
    """The shuffle that merges equal rows also serves the write."""
    plans = []
    plain = writers.insert_by_name

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *more)

    monkeypatch.setattr(writers, "insert_by_name", seen)
    gap = [gap_row(i % 40, month=200001 + i % 2, week=(W, 20000211)[i % 2]) for i in range(200)]
    claims = run(gap, [main_row(7), main_row(8)], [added_row(8)], last=200002, by_month=True)
    plain_rows = run(gap, [main_row(7), main_row(8)], [added_row(8)], last=200002)
    stored = collect.store_extract(claims, "t.claims_by_month", year2000, M, 200002, by_month=True)
    assert rows(stored, *plain_rows.columns) == rows(plain_rows) and stored.count() == 42
    assert "REBALANCE" not in plans[0] and plans[0].count("Exchange hashpartitioning(month_id") == 1


def test_hot_record_is_not_paired_copy_by_copy(run):
    """Many copies of one record in both feeds stay one output row."""
    got = run([], [main_row(1)] * 500, [added_row(1)] * 500)
    assert got.count() == 1


def test_against_brute_force(run):
    """Random feeds with repeated keys, codes outside the list and several months."""
    dice = random.Random(2)
    weeks = {200001: (20000107, 20000204), 200002: (20000204, 20000303)}

    def row(kind):
        month = dice.choice([200001, 200002])
        claim, code = dice.randint(1, 6), dice.choice("AAB")
        week = dice.choice([20000107, 20000204, 20000303])
        if kind == "main":
            return (claim, 1, 1, code, 9, 7, dice.choice("xy"), OLD, week, month)
        return (claim, 1, 1, code, 9, 7, dice.choice("xy"), dice.choice([OLD, NEW, None]), dice.randint(1, 2), week, month)

    gap, main, added = ([row(k) for _ in range(40)] for k in ("gap", "main", "added"))

    def kept(rows):
        return [r for r in rows if r[3] == "A" and weeks[r[-1]][0] <= r[-2] <= weeks[r[-1]][1]]

    want = set(kept(gap))
    for m in kept(main):
        matches = [a for a in kept(added) if (a[0], a[1], a[2], a[-1]) == (m[0], m[1], m[2], m[-1])]
        for load, age in [(a[7], a[8]) for a in matches] or [(None, None)]:
            want.add((*m[:7], load or m[7], age, *m[8:]))
    got = [tuple(r) for r in run(gap, main, added, last=200002).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
