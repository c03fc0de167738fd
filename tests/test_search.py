import random
import re
from collections import Counter

import pytest

from cohortkit.operators import search as op

DICE = random.Random(6)
TEXTS = [(i * 701, " ".join(DICE.choice(["The", "the", "of", "a1", "Éa", "x_y", "42", "so-so"]) for _ in range(DICE.randint(0, 40)))) for i in range(60)]
TEXTS += [(7, None), (8, ""), (9, " -- "), (None, "the of the"), (-5, "THE the. The, of"), (10, "the " * 500 + "of")]


def words(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower())]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([(*t, "x") for t in TEXTS], "doc_id long, text string, term string").repartition(3)
    return op.build_index(docs, str(tmp_path_factory.mktemp("index") / "postings"))


def test_statistics(index):
    held = [(i, words(t)) for i, t in TEXTS if i is not None]
    want = {w: (sum(w in ws for _, ws in held), sum(ws.count(w) for _, ws in held)) for _, ws in held for w in ws}
    assert {r.term: (r.n_docs, r.n_hits) for r in op.term_statistics(index).collect()} == want


@pytest.mark.parametrize("match", ["all", "any"])
def test_keywords(spark, index, match):
    queries = {"one": ["the"], "two": ["THE", "of", "of"], "three": ["a1", "éa", "42"], "none": ["missing", "the"]}
    want = set()
    for name, terms in queries.items():
        terms = {t.lower() for t in terms}
        for i, text in TEXTS:
            hits = Counter(w for w in words(text) if w in terms)
            if i is not None and hits and (match == "any" or len(hits) == len(terms)):
                want.add((name, i, len(hits), sum(hits.values()), tuple(sorted(hits.items()))))
    flat = lambda df: {(r["query"], r.doc, r.n_terms, r.n_hits, tuple(sorted(r.hits.items()))) for r in df.collect()}
    assert flat(op.search(index, queries, match)) == want
    assert flat(op.search(index, op.as_queries(spark, queries), match)) == want
    with pytest.raises(ValueError):
        op.search(index, queries, "most")


def test_phrases(index):
    queries = {"a": ["the", "of"], "b": ["the", "the"], "c": ["of", "the", "the", "a1"], "d": ["42"], "e": ["the", "missing"]}
    want = {}
    for name, phrase in queries.items():
        for i, text in TEXTS:
            ws = words(text)
            n = sum(ws[k : k + len(phrase)] == phrase for k in range(len(ws)))
            if n and i is not None:
                want[name, i] = n
    assert {(r["query"], r.doc): r.n_hits for r in op.search_phrases(index, queries).collect()} == want


def test_only_the_folders_of_the_terms_are_read(index):
    plan = op.search(index, {"q": ["the", "of"]})._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan parquet")[1:]]
    assert scans and all("PartitionFilters: [folder" in s and "(term" in s for s in scans)
    assert "text" not in " ".join(s.split("ReadSchema")[1][:120] for s in scans)
    # Blocks meet on two columns, without the postings.
    assert any("docs" not in s.split("ReadSchema")[1].split("\n")[0] for s in scans)


def test_ids_must_be_numbers_and_an_empty_table(spark, tmp_path):
    with pytest.raises(ValueError):
        op.build_index(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path / "x"))
    empty = op.build_index(spark.createDataFrame([], "doc_id int, text string"), str(tmp_path / "y"))
    assert op.search(empty, {"q": ["a"]}).count() == 0 and op.term_statistics(empty).count() == 0
    assert op.search(empty, {}).count() == 0


def test_repeated_ids_and_ids_of_all_sizes(spark, tmp_path):
    big = 2**62 + 1
    docs = spark.createDataFrame([(3, "a b a"), (3, "b a"), (big, "a a"), (-big, "b a"), (4, "a")], "doc_id long, text string").repartition(5)
    index = op.build_index(docs, str(tmp_path / "z"))
    assert {r.term: (r.n_docs, r.n_hits) for r in op.term_statistics(index).collect()} == {"a": (4, 7), "b": (2, 3)}
    assert {(r.doc, r.n_hits) for r in op.search(index, {"q": ["a"]}).collect()} == {(3, 3), (big, 2), (-big, 1), (4, 1)}
    assert {(r.doc, r.n_hits) for r in op.search_phrases(index, {"q": ["a", "a"]}).collect()} >= {(big, 1)}


def test_words_are_grouped_before_they_are_shuffled():
    import numpy as np
    import pyarrow as pa

    found = op.postings(np.array([5, 4096, 1]), pa.array([["x", "y", "x"], ["x"], ["x"]])).to_pylist()
    assert sorted((r["term"], r["block"], [(d["at"], d["steps"]) for d in r["docs"]], r["n_hits"]) for r in found) == [
        ("x", 0, [(1, [0]), (5, [0, 2])], 3),
        ("x", 1, [(0, [0])], 1),
        ("y", 0, [(5, [1])], 1),
    ]
