import numpy as np
import pytest

from cohortkit.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double"


def brute(rows, queries, k):
    units = {i: np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for i, v in rows}
    return {q: sorted(((-round(float(units[q] @ u), 9), i) for i, u in units.items() if i != q))[:k] for q in queries}


def recall(got, want):
    return np.mean([len({i for _, i in w} & got.get(q, set())) / len(w) for q, w in want.items()])


def test_recall_and_scores(spark):
    dice = np.random.default_rng(1)
    rows = [(i, dice.normal(size=16).astype(np.float32).tolist(), 0.0) for i in range(3000)]
    data = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = ann.nearest(data, data.where("vec_id % 50 = 0"), 5, skip_self=True).collect()
    want = brute([r[:2] for r in rows], range(0, 3000, 50), 5)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert all([r.rank for r in rs] == [1, 2, 3, 4, 5] and [r.score for r in rs] == sorted((r.score for r in rs), reverse=True) for rs in got.values())
    assert recall({q: {r.vec_id for r in rs} for q, rs in got.items()}, want) >= 0.95
    exact = {(q, i): -s for q, w in want.items() for s, i in w}
    assert all(abs(exact[q, r.vec_id] - r.score) < 1e-6 for q, rs in got.items() for r in rs if (q, r.vec_id) in exact)


def test_copies_and_vectors_that_take_no_part(spark):
    """A third of the rows are one vector; the least ids of the ties come first."""
    dice = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else dice.normal(size=4).astype(np.float32).tolist(), 0.0) for i in range(900)]
    bad = [(1000, None, 0.0), (1001, [0.0] * 4, 0.0), (1002, [1.0, None, 1.0, 1.0], 0.0), (1003, [float("nan")] * 4, 0.0), (1004, [float("inf")] * 4, 0.0), (1005, [1.0] * 7, 0.0), (None, [1.0] * 4, 0.0)]
    data = spark.createDataFrame(rows + bad + rows[:3], SCHEMA)
    found = ann.nearest(data, data.where("vec_id in (0, 6, 1000, 1001, 1002, 1003, 1004, 1005)"), 5, skip_self=True).collect()
    got = {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in found}}
    assert got == {0: [3, 6, 9, 12, 15], 6: [0, 3, 9, 12, 15]}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, n):
    data = spark.createDataFrame([(i, [1.0, float(i)], 0.0) for i in range(n)], SCHEMA)
    found = ann.nearest(data, data, 5, skip_self=True).collect()
    assert len(found) == n * max(0, n - 1)
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 0] == list(range(1, n))


def test_shuffles_of_a_round_and_of_a_step(spark, monkeypatch):
    """The driver plans and tracks every shuffle of every round, so each table is written with few of them."""
    seen = []
    plain = ann.written

    def counted(df, name="scratch"):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return plain(df, name)

    monkeypatch.setattr(ann, "written", counted)
    dice = np.random.default_rng(3)
    data = spark.createDataFrame([(i, dice.normal(size=8).astype(np.float32).tolist(), 0.0) for i in range(400)], SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ann.nearest(data, data.where("vec_id % 50 = 0"), 5, skip_self=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    most = {name: max(n for other, n in seen if other == name) for name, _ in seen}
    assert most["meetings"] <= 3 and most["found"] <= 5 and most["beam"] <= 8
    assert "visits" not in most
