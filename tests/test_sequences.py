import random
from collections import Counter

import numpy as np
import pytest

from cohortkit.operators import sequences


def texts(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "doc long, text string")


def test_lengths(spark):
    data = texts(spark, ["a", "a|b", "a|b|c", "|".join("x" * 10)])
    got = {r.pct: r.length for r in sequences.length_percentiles(data, percents=(75, 95)).collect()}
    assert got == {75.0: pytest.approx(4.75), 95.0: pytest.approx(8.95)}
    whole = {r.pct: r.length for r in sequences.length_percentiles(data, percents=(75, 95), truncate=True).collect()}
    assert whole == {75.0: 4, 95.0: 8}


def test_lengths_as_numpy(spark):
    dice = random.Random(1)
    sizes = [dice.randint(1, 60) for _ in range(97)]
    got = {r.pct: r.length for r in sequences.length_percentiles(texts(spark, ["|".join("a" * n) for n in sizes])).collect()}
    assert got == {float(p): pytest.approx(np.percentile(sizes, p)) for p in sequences.PERCENTILES}


def vocab(df):
    return {r.token: (r["index"], r["count"]) for r in df.collect()}


def test_vocab(spark):
    data = texts(spark, ["b|a", "A|c|b|a"])
    want = {"a": (1, 3), "b": (2, 2), "c": (3, 1)}
    assert vocab(sequences.build_vocab(data, "doc")) == want
    assert vocab(sequences.top_vocab(data, "doc", 3)) == {t: v for t, v in want.items() if v[0] < 3}
    assert vocab(sequences.build_vocab(texts(spark, ["x|y", "y|x"]), "doc")) == {"x": (1, 2), "y": (2, 2)}


def seqs(df):
    return [tuple(r)[1:] for r in df.orderBy("doc").collect()]


def test_encode(spark):
    data = texts(spark, ["b|a", "A|c|b|a", "", "c||c", None])
    assert seqs(sequences.encode(data, "doc", 3, 2)) == [(1, 0), (2, 1), (0, 0), (2, 2), (0, 0)]
    small = texts(spark, ["b|a", "A|c|b|a"])
    assert seqs(sequences.encode(small, "doc", 3, 5)) == [(2, 1, 0, 0, 0), (1, 2, 1, 0, 0)]
    assert seqs(sequences.encode(small, "doc", None, 3)) == [(2, 1, 0), (3, 2, 1)]
    assert sequences.encode(small, "doc", 3, 2).columns == ["doc", "seq_0", "seq_1"]


@pytest.fixture(params=["small vocabulary", "large vocabulary"])
def vocabulary_size(request, spark, monkeypatch):
    """The second case ranks by slices and joins without broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    if request.param.startswith("large"):
        spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, usual)


def test_against_brute_force(spark, vocabulary_size):
    dice = random.Random(5)
    items = ["|".join(dice.choice("abcdefghij") * dice.choice([1, 1, 2]) for _ in range(dice.randint(0, 30))) for _ in range(40)]
    counts = Counter(t for text in items for t in text.split("|") if t)
    index = {t: i + 1 for i, (t, _) in enumerate(counts.most_common())}
    data = texts(spark, items).repartition(5)
    assert vocab(sequences.build_vocab(data, "doc", slices=4)) == {t: (i, counts[t]) for t, i in index.items()}
    want = []
    for text in items:
        ids = [index[t] for t in text.split("|") if t and index[t] < 9][-7:]
        want.append(tuple(ids + [0] * (7 - len(ids))))
    assert seqs(sequences.encode(data, "doc", 9, 7)) == want


def test_tokens_stay_where_a_bounded_vocabulary_can_go_to_them(spark):
    data = texts(spark, ["b|a", "A|c|b|a", None])
    words = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "token string, index long")
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        few, many = (sequences.encode(data, "doc", n, 3, vocab=words) for n in (3, sequences.BROADCAST_WORDS + 1))
        plans = ["SortMergeJoin" in x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
        assert plans == [False, True]
        assert seqs(few) == [(2, 1, 0), (1, 2, 1), (0, 0, 0)] and seqs(many) == [(2, 1, 0), (3, 2, 1), (0, 0, 0)]
    finally:
        spark.conf.set(key, usual)


def test_vectors_and_matrix(spark, tmp_path):
    path = tmp_path / "vectors.txt"
    path.write_text("a 1 2\nb 3 4.5 \t\na 5 6\n")
    vectors = sequences.load_vectors(spark, str(path))
    assert {r.word: r.vector for r in vectors.collect()} == {"a": [5.0, 6.0], "b": [3.0, 4.5]}
    words = spark.createDataFrame([("a", 1), ("q", 2), ("b", 4)], "token string, index long")
    got = [(r["index"], r.vector) for r in sequences.embedding_matrix(words, vectors, 4, 2).orderBy("index").collect()]
    assert got == [(0, [0.0, 0.0]), (1, [5.0, 6.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])]
