"""Every registered query of the corpus operators, and the pipeline stage by stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from cohortkit.llm import exact_dedup, near_dedup
from cohortkit.llm.queries import ORACLE, QUERIES
from cohortkit.session import written

SF = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_sharding", "op9_line_dedup"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    docs = given = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, SF), name)
        assert docs.columns == given.columns and docs.exceptAll(before).isEmpty()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        judged = before.join(labels, "doc_id").withColumn("stays", F.col("doc_id").isin(list(kept[name])))
        if name in ("toxicity", "quality"):
            clean = judged.where("toxic = 0" if name == "toxicity" else "quality = 1")
            assert clean.agg(F.avg(F.col("stays").cast("int"))).first()[0] > 0.97
        texts = before.select("doc_id", exact_dedup.normalised(F.col("text")).alias("t"))
        if name == "exact_dedup":
            assert kept[name] == {r.i for r in texts.groupBy("t").agg(F.min("doc_id").alias("i")).collect()}
        if name == "near_dedup":
            classes = near_dedup.near_duplicates(before)
            assert kept[name] == {r.i for r in classes.groupBy("class_id").agg(F.min("doc_id").alias("i")).collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept["near_dedup"]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 4096").count() <= 1


def test_statistics_are_computed_once_for_all_rules(spark, monkeypatch):
    names = list(corpus_pipeline.quality.statistics(F.lit("")))
    rules = [(((n, 0.1, 0.9),), 0.5) for n in names] + [(((n, 0.2, 0.8), ("chars", 10.0, 5000.0)), -0.5) for n in names]
    ensemble = corpus_pipeline.quality.RuleEnsemble(-1.0, rules)
    monkeypatch.setattr(corpus_pipeline.quality, "fit", lambda *_: ensemble)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_low_quality(spark, docs, SF)
    patterns = sum("regexp_replace" in str(c) for c in corpus_pipeline.quality.statistics(F.lit("")).values())
    assert 0 < kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= patterns
    scored = written(corpus_pipeline.quality.add_score(docs, ensemble, "_quality"), "scored")
    want = scored.where(F.col("_quality") >= corpus_pipeline.QUALITY).drop("_quality")
    assert kept.exceptAll(want).isEmpty() and want.exceptAll(kept).isEmpty() and not want.isEmpty()


def test_one_row_of_each_group_stays(spark):
    """Also where ids are null or repeat, and where whole rows repeat."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "some words that are long enough to be shingles of five words each and then some more of them here"
    rows = [(None, "t"), (None, "t"), (None, "u"), (5, "v"), (5, "v"), (5, "w"), (7, "t "), (8, "x  y"), (9, "x y"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(None, "t"), (7, "t "), (None, "u"), (5, "v"), (5, "w"), (8, "x  y"), (3, None)], key=repr)
    rows = [(None, words), (None, words), (None, words + " end"), (6, "lone text of one kind"), (6, "lone text of one kind"), (2, words + " of two"), (1, ""), (None, None), (None, "z z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(2, words + " of two"), (6, "lone text of one kind"), (1, ""), (None, None), (None, "z z")], key=repr)


def test_pipeline_over_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "some words here", "en", "s", 1), (4, "some words here", "en", "s", 1), (4, "some words here", "en", "s", 1)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for name, given in (("odd", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == bool(given)
