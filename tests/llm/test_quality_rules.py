import math

from pyspark.sql import functions as F

from cohortkit.llm import langid, quality as op

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = langid.is_held_out(F.col("doc_id"), 5, 0)
    ensemble = op.fit(docs.where(~held), labels)
    assert 0 < len(ensemble.rules) < 150
    scored = op.score(docs.where(held), ensemble)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.98


def test_rules_as_columns(spark):
    ensemble = op.RuleEnsemble(-1.0, [((("chars", 2.0, math.inf),), 2.0), ((("bars", -math.inf, 0.0), ("chars", 0.0, 3.0)), -0.5)])
    docs = spark.createDataFrame([(1, None, 7.0), (2, "abc", 7.0), (3, "a|cd", 7.0), (3, "a|cd", 7.0), (4, "", None)], "doc_id long, text string, score double")
    got = sorted(((r.doc_id, round(r.score, 6), r.predicted) for r in op.score(docs, ensemble).collect()))
    logistic = lambda x: round(1 / (1 + math.exp(-x)), 6)
    assert got == [(1, logistic(-1), 0), (2, logistic(0.5), 1), (3, logistic(1), 1), (3, logistic(1), 1), (4, logistic(-1), 0)]
    assert op.score(docs.limit(0), ensemble).count() == 0
    assert op.add_score(docs, ensemble, "q").columns == ["doc_id", "text", "score", "q"]


def test_labels_of_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.predicted for r in op.score(docs, op.fit(docs, labels)).collect()} == {1}
    assert {round(r.score, 6) for r in op.score(docs, op.fit(docs, labels.limit(0))).collect()} == {0.5}
