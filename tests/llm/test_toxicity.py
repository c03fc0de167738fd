import tracemalloc
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortkit import session
from cohortkit.llm import langid, toxicity as op, words

SF = "/root/testdata/sf0.1"


def test_search_is_exact():
    """Blocks visited by falling bound give the same neighbours as all cosines."""
    dice = np.random.default_rng(3)
    names = [f"t{i}" for i in range(40)]
    rows = [(i, int(dice.random() < 0.4), {names[j]: int(dice.integers(1, 4)) for j in dice.choice(40, dice.integers(1, 6), replace=False)}) for i in range(700)]
    index = op.build_index(rows, {t: float(1 + dice.random() * 4) for t in names})
    dense = np.concatenate([p.T for p in index.postings])
    assert np.allclose((dense**2).sum(axis=1), 1)
    for _ in range(100):
        at, weights = index.vector({int(j): int(dice.integers(1, 4)) for j in dice.choice(40, 4, replace=False)})
        found, cosines = index.nearest(at, weights)
        every = dense[:, at] @ weights
        best = np.lexsort((np.arange(len(every)), -every))[: op.NEIGHBOURS]
        assert np.allclose(cosines, every[best]) and np.allclose(every[found], cosines)


def test_words_of_ascii_texts():
    for text in (None, "", "Don't 12a_b\x00C\n\tx--Y\x1fz", "".join(map(chr, range(128))), "é" + "".join(map(chr, range(128)))):
        assert op.terms(text) == op.LETTERS.findall((text or "").lower())


def test_counting_gives_back_what_other_stages_kept_and_holds_few_words():
    """A worker that packed before holds no tokenizer while it counts, and passes words on before there are many."""
    coder = words.load(public_tokenizers.path("word_bpe_49k.json"))
    assert words.load(public_tokenizers.path("word_bpe_49k.json")) is coder and session._KEPT
    every = ["".join(x) for x in product("abcdefghijklmnopqrstuvwxyz", repeat=4)][:450_000]
    batch = pa.RecordBatch.from_pydict({"text": [None, ""] + [" ".join(["common", *every[at : at + 300]]) for at in range(0, len(every), 300)]})
    tracemalloc.start()
    sizes = []
    for part in op.counted(iter([batch])):
        assert not session._KEPT
        sizes.append(part.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = Counter()
    for part in op.counted(iter([batch])):
        total.update(dict(zip(part["term"].to_pylist(), part["n"].to_pylist())))
    assert total.pop(None) == 1502 and total.pop("common") == 1500 and total == dict.fromkeys(every, 1)
    assert len(sizes) > 2 and max(sizes) <= op.FLUSH + 301 and peak < 60e6


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('plain words number ', id, case when id % 4 = 0 then ' nasty nasty' else ' kind' end) as text", "'k' as label")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) as toxic")
    return docs, labels


def test_scores_and_evidence(spark, labelled):
    index = op.fit(*labelled)
    texts = [(1, "so nasty"), (2, "so kind"), (3, None), (4, ""), (5, "nasty " * 30_000), (6, "other"), (6, "other")]
    got = {r.doc_id: r for r in op.score(spark.createDataFrame(texts, "doc_id long, text string"), index).collect()}
    assert [got[i].predicted for i in range(1, 7)] == [1, 0, 0, 0, 1, 0]
    assert got[1].score > 0.9 > 0.1 > got[2].score and all(e.label == 1 for e in got[1].evidence) and got[3].evidence == []


def test_a_row_with_both_labels_is_toxic(spark, labelled):
    docs, labels = labelled
    both = labels.unionByName(labels.where("toxic = 1").withColumn("toxic", F.lit(0).cast("int")))
    texts = spark.createDataFrame([(1, "so nasty"), (2, "so kind")], "doc_id long, text string")
    scores = [sorted((r.doc_id, round(r.score, 9)) for r in op.score(texts, op.fit(docs, given)).collect()) for given in (labels, both.repartition(7))]
    assert scores[0] == scores[1]


def test_no_labels_one_class_and_no_rows(spark, labelled):
    docs, labels = labelled
    for given in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        index = op.fit(docs, given)
        assert {tuple(r) for r in op.score(docs, index).select("score", "predicted").collect()} == {(0.0, 0)}
    assert op.score(docs.limit(0), op.fit(docs, labels)).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = langid.is_held_out(F.col("doc_id"), 5, 0)
    found = op.score(docs.where(held), op.fit(docs.where(~held), labels)).join(labels, "doc_id")
    assert found.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.97


@pytest.mark.parametrize("common", [0, 200_000])
def test_all_words_count(spark, labelled, monkeypatch, common):
    """Cosines over all words, also those that no example has, whether tasks hold their counts or they are joined."""
    monkeypatch.setattr(op, "COMMON", common)
    docs, labels = labelled
    more = spark.createDataFrame([(1000 + i, "other " * (1 + i % 3) + "rare" + "abcdefghijklmnopqrst"[i // 2] + " strange nasty") for i in range(40)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    index = op.fit(docs, labels, all_docs=every)
    texts = [r.text for r in every.collect()]
    seen = op.Counter(t for x in texts for t in set(op.terms(x)))
    idf = {t: op.math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in seen.items()}
    weight = idf | {t: index.weight[i] for t, i in index.vocabulary.items() if i < index.n_terms}
    assert all(w >= idf[t] - 1e-9 for t, w in weight.items())

    def vector(text):
        v = {t: (1 + op.math.log(n)) * weight[t] for t, n in op.Counter(op.terms(text)).items()}
        length = sum(x * x for x in v.values()) ** 0.5
        return {t: x / length for t, x in v.items()}

    by_id = {str(r.doc_id): vector(r.text) for r in docs.collect()}
    found = {r.doc_id: r for r in op.score(more, index).collect()}
    for r in more.collect():
        v, near = vector(r.text), found[r.doc_id].evidence
        assert len(near) == op.EVIDENCE
        assert np.allclose([e.cosine for e in near], [sum(x * by_id[e.id].get(t, 0) for t, x in v.items()) for e in near])
    # No word of the first depends on the label, and one insult in a long text is not an insult alone.
    given = spark.createDataFrame([(1, "words number"), (2, "nasty"), (3, "nasty " + " ".join(f"long{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)))], "doc_id long, text string")
    got = {r.doc_id: r.evidence for r in op.score(given, index).collect()}
    assert len(got[1]) == op.EVIDENCE and got[2][0].cosine > got[3][0].cosine + 0.3


def test_rare_toxic_words_weigh(spark):
    """Insults that a few examples have each, in texts of common words: none has a G of 20 or five examples."""
    rows = [(i, 0, {"one": 1, "two": 1}) for i in range(1000)] + [(1000 + i, 1, {"one": 1, f"insult{i // 4}": 1}) for i in range(100)]
    found = op.signals(rows)
    assert 15 < found["insult3"] < 20 and found["insult3"] > found["one"] >= 0
    word = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    dice = np.random.default_rng(1)
    text = lambda *more: " ".join([*dice.choice(word, 30), *more])
    toxic = [(i, text("insult" + "abcdefghij"[i // 8]), 1) for i in range(80)]
    docs = spark.createDataFrame(toxic + [(100 + i, text(), 0) for i in range(400)], "doc_id long, text string, toxic int")
    given = spark.createDataFrame([(i, text("insult" + "abcdefghij"[i])) for i in range(10)] + [(10 + i, text()) for i in range(10)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.score(given, op.fit(docs, docs)).collect()}
    assert sum(got[i].evidence[0].label for i in range(10)) >= 9
    assert min(got[i].score for i in range(10) if got[i].evidence[0].label) > max(got[i].score for i in range(10, 20))
