import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import langid as op

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "the house and the garden with this water", "en") for i in range(20)]
    rows += [(20 + i, "das haus und der garten mit diesem wasser", "de") for i in range(20)]
    rows += [(40 + i, "дом и сад с этой водой", "ru") for i in range(20)] + [(60, None, "en"), (61, "no label", None)]
    return op.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_text(spark, model):
    texts = [
        (1, "the garden and the house"), (2, "das haus der garten"), (3, "the house with this garden das haus mit diesem garten und wasser"),
        (4, "дом the house садом"), (5, None), (6, ""), (7, "12 !! 34"), (8, "漢字"), (9, "дом"), (9, "дом"),
    ]
    docs = spark.createDataFrame([(*t, 0.5) for t in texts], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in op.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 5, 6, 7, 9)] == ["en", "de", "und", "und", "und", "ru"]
    assert [tuple(s) for s in got[3].spans] == [(0, 5, "en"), (5, 12, "de")] and 0.5 < got[3].score < 0.6
    assert [s.lang for s in got[4].spans] == ["ru", "en", "ru"]
    assert [tuple(got[i][1:3]) for i in (5, 6, 7)] == [("und", 0.0)] * 3
    assert got[8].lang_pred in model.langs and op.predict(docs, model).count() == len(texts)


def test_paths_are_the_best_ones(model):
    labeller, dice = op.Labeller(model), np.random.default_rng(1)
    labeller.scores = dice.normal(0, 12, (50, 3)).astype(np.float32)
    lists = [dice.integers(0, 50, n) for n in (6, 1, 3, 6, 5)]
    for rows, labels in zip(lists, labeller.paths(lists)):
        def value(path):
            return sum(float(labeller.scores[r, s]) for r, s in zip(rows, path)) - op.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=len(rows)), key=value)
        assert abs(value(best) - value(labels.tolist())) < 1e-3


def test_cache_limit_changes_nothing(model, monkeypatch):
    texts = [f"the house {i} das haus{i} garten" for i in range(50)]
    usual = op.Labeller(model).label(texts)
    monkeypatch.setattr(op, "CACHE", 3)
    small = op.Labeller(model)
    assert [small.label([t]).lang_pred[0] for t in texts] == usual.lang_pred.tolist() and len(small.known) == 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = op.is_held_out(F.col("doc_id"), 4, 2)
    found = op.predict(docs.where(held), op.train(docs.where(~held))).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_no_labels_and_no_rows(spark, model):
    empty = op.train(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "the house")], "doc_id long, text string")
    assert [tuple(r) for r in op.predict(docs, empty).collect()] == [(1, "und", 0.0, [])]
    assert op.predict(docs.limit(0), model).count() == 0
