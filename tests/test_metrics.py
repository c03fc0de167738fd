import random

import pytest
from pyspark.sql import functions as F

from cohortkit.functions.running import running_totals
from cohortkit.operators import metrics

SMALL = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)]


def scores(spark, rows):
    return spark.createDataFrame(rows, "y_true int, score double")


def curve(df, *columns):
    return sorted((tuple(r) for r in df.select("threshold", *columns).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_at_k(spark):
    got = {r.k: (r.precision, r.recall, r.threshold) for r in metrics.precision_recall_at_k(scores(spark, SMALL), [1, 2, 3, 4, 5]).collect()}
    tied = (pytest.approx(2 / 3), 1.0, 0.8)
    assert got == {1: (1.0, 0.5, 0.9), 2: tied, 3: tied, 4: (0.5, 1.0, 0.1)}
    with pytest.raises(ValueError):
        metrics.precision_recall_at_k(scores(spark, SMALL), [0])


def test_at_k_without_positives(spark):
    assert [(r.precision, r.recall) for r in metrics.precision_recall_at_k(scores(spark, [(0, 0.5)]), [1]).collect()] == [(0.0, 0.0)]


def test_areas(spark):
    assert metrics.average_precision(scores(spark, SMALL)).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.roc_auc(scores(spark, SMALL)).first()[0] == pytest.approx(0.875)
    assert metrics.roc_auc(scores(spark, [(1, 0.2)])).first()[0] is None


def test_pr_curve(spark):
    got = curve(metrics.pr_curve(scores(spark, SMALL)), "precision", "recall")
    assert got == [(None, 1.0, 0.0), (0.1, 0.5, 1.0), (0.8, pytest.approx(2 / 3), 1.0), (0.9, 1.0, 0.5)]


def test_roc_curve(spark):
    got = curve(metrics.roc_curve(scores(spark, SMALL)), "fpr", "tpr")
    assert got == [(None, 0.0, 0.0), (0.1, 1.0, 1.0), (0.8, 0.5, 1.0), (0.9, 0.0, 0.5)]


def test_roc_curve_drops_points_on_a_line(spark):
    line = [(0, 0.4), (0, 0.3), (0, 0.2), (1, 0.1)]
    assert [r[0] for r in curve(metrics.roc_curve(scores(spark, line)), "fpr")] == [None, 0.1, 0.2, 0.4]
    assert len(curve(metrics.roc_curve(scores(spark, line), drop_intermediate=False), "fpr")) == 5


def test_missing_score_is_an_error(spark):
    with pytest.raises(Exception, match="must not be missing"):
        metrics.roc_auc(scores(spark, [(1, None)])).collect()


def brute_curve(rows):
    points, positives = [], sum(y for y, _ in rows)
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(y for y, s in rows if s >= t)
        fp = sum(1 - y for y, s in rows if s >= t)
        points.append((t, tp, fp, positives, len(rows) - positives))
    return points


def brute_auc(rows):
    pairs = [(a, c) for y, a in rows if y for z, c in rows if not z]
    return sum(1.0 if a > c else 0.5 if a == c else 0.0 for a, c in pairs) / len(pairs)


@pytest.mark.parametrize("slices", [1, 5])
def test_against_brute_force_by_model(spark, slices):
    dice = random.Random(7)
    models = {m: [(dice.randint(0, 1), dice.randint(0, 40) / 8) for _ in range(150)] for m in ("a", "b")}
    models[None] = [(1, 0.5), (0, 0.25)]
    df = spark.createDataFrame([(m, y, s) for m, rows in models.items() for y, s in rows], "model string, y_true int, score double")
    table = metrics.score_table(df, "model", slices=slices, lead=True).collect()
    for m, rows in models.items():
        mine = sorted((r for r in table if r.model == m), key=lambda r: -r.threshold)
        want = brute_curve(rows)
        assert [(r.threshold, r.cum_tp, r.cum_fp, r.all_tp, r.all_fp) for r in mine] == want
        assert [(r.next_tp, r.next_fp) for r in mine] == [(r.tp, r.fp) for r in mine[1:]] + [(None, None)]
    auc = {r.model: r.roc_auc for r in metrics.roc_auc(df, "model", slices=slices).collect()}
    assert auc == {m: pytest.approx(brute_auc(rows)) for m, rows in models.items()}
    flipped = {r.model: r.roc_auc for r in metrics.roc_auc(df.withColumn("score", -F.col("score")), "model").collect()}
    assert all(auc[m] + flipped[m] == pytest.approx(1) for m in models)


def test_running_totals_over_two_order_columns(spark):
    dice = random.Random(3)
    data = [(dice.randint(0, 5), i, dice.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(data, "a int, b int, v long")
    got = {r.b: (r.cum_v, r.all_v) for r in running_totals(df, [("a", True), ("b", False)], ["v"], slices=6).collect()}
    total, want = 0, {}
    for a, b, v in sorted(data, key=lambda r: (-r[0], r[1])):
        total += v
        want[b] = total
    assert got == {b: (c, total) for b, c in want.items()}
    with pytest.raises(ValueError):
        running_totals(df, [("a", True), ("b", False)], ["v"], lead=["v"])
