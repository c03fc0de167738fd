import math
import random

import numpy as np
import pytest

from cohortkit.operators import vectors as op


def brute(rows, queries, k, skip_self):
    held = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = []
    for q, _ in queries:
        if q in held:
            scored = sorted((-float(held[q] @ v / (np.linalg.norm(held[q]) * np.linalg.norm(v))), i) for i, v in held.items() if not (skip_self and i == q))
            out += [(q, r + 1, i, round(-s, 9) + 0.0) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def clustered(n, dim=8, groups=10):
    dice = np.random.default_rng(3)
    middles = dice.normal(size=(groups, dim)) * 10
    # A third of the vectors lie around one middle.
    of = [0 if i % 3 == 0 else int(dice.integers(groups)) for i in range(n)]
    return [(i, (middles[g] + dice.normal(size=dim) * 0.3).tolist()) for i, g in zip(range(n), of)]


@pytest.mark.parametrize("skip_self", [True, False])
def test_against_all_pairs(spark, monkeypatch, skip_self):
    rows = clustered(300) + [(900, None), (901, [0.0] * 8), (902, [math.nan] + [1.0] * 7), (903, [math.inf] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [5.0] * 8), (906, [2.5] * 8)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = [r for r in rows if r[0] % 7 == 0 or r[0] >= 900]
    asked = data.where("vec_id % 7 = 0 OR vec_id >= 900")
    monkeypatch.setattr(op, "PART_ROWS", 20)
    got = op.nearest(data, asked, 4, skip_self=skip_self).collect()
    assert sorted((r["query"], r["rank"], r.id, round(r.score, 9) + 0.0) for r in got) == brute(rows, queries, 4, skip_self)


def test_clusters_rule_most_pairs_out(spark):
    data = spark.createDataFrame(clustered(600), "vec_id long, embedding array<double>")
    assert op.pruned_share(data, data.where("vec_id % 20 = 0"), 3) > 0.5


def test_few_vectors_ties_and_none(spark):
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query"], r["rank"], r.id, r.score) for r in op.nearest(data, data, 5).collect())
    assert [x[:3] for x in got if x[0] == 2] == [(2, 1, 2), (2, 2, 1), (2, 3, 3)] and len(got) == 9
    assert op.nearest(data.limit(0), data, 2).count() == 0 and op.nearest(data, data.limit(0), 2).count() == 0


def test_plan_has_no_cross_join_and_no_python(spark):
    data = spark.createDataFrame(clustered(60), "vec_id long, embedding array<double>")
    plan = op.nearest(data, data.where("vec_id < 5"), 2)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Cartesian", "NestedLoop", "Python", "Pandas"))


def test_vectors_of_other_lengths_and_names_as_ids(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [3.0, 4.0]), ("d", [0.0, 2.0, 0.0]), ("e", [2.0, 0.0]), ("f", [1.0])]
    data = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    for clusters in (None, 1, 6):
        got = sorted((r["query"], r["rank"], r.id, round(r.score, 9)) for r in op.nearest(data, data, 2, skip_self=True, clusters=clusters).collect())
        assert got == [("a", 1, "e", 1.0), ("a", 2, "c", 0.6), ("b", 1, "d", 0.0), ("c", 1, "a", 0.6), ("c", 2, "e", 0.6), ("d", 1, "b", 0.0), ("e", 1, "a", 1.0), ("e", 2, "c", 0.6)]


def test_a_block_gives_only_the_best_and_keeps_ties():
    units = np.array([[1.0, 0.0]] * 500 + [[0.0, 1.0]])
    ids = np.arange(501)[::-1]
    row, col, score = op.best_of_block(np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([-math.inf, 0.5]), np.array([1, -1]), units, ids, 3)
    assert row.tolist() == [0, 0, 0, 1] and ids[col].tolist() == [2, 3, 4, 0] and score.tolist() == [1.0] * 4
