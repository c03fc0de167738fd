import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cohortkit.llm import near_dedup as op


def brute(rows):
    """Class of every id: the least id that links of similar shingle sets lead to."""
    sets = {i: op.shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= op.SIMILARITY:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: root(i) for i in sets}


def check(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", op.normalised(F.col("text"))).collect()]
    got = op.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got) and len(got) == len(rows)


def test_given_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_large_group_of_near_copies(spark):
    """Copies differ from one text in up to three places, so some pairs in the group are not linked directly."""
    dice = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(dice.randint(0, 3)):
            words[dice.randrange(120)] = f"x{dice.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, f"this is quite another text number {i} with some more words {i * 7}") for i in range(50)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_nulls_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (6, "one"), (None, "one"), (None, "z"), (7, "a " * 20_000), (8, "a " * 19_000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in op.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (6, 6, True), (None, 6, False), (None, None, True), (7, 7, True), (8, 7, False)], key=repr)
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    """Share of equal registers against the exact probability Jaccard similarity of weighted sets."""
    dice = np.random.default_rng(2)
    elements = op._mix(np.arange(300, dtype=np.uint64))
    a, b = dice.exponential(1, 300) * (dice.random(300) < 0.8), dice.exponential(1, 300)
    b = np.where(dice.random(300) < 0.7, a, b)
    both = (a > 0) & (b > 0)
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    sketcher = op.Sketcher(4096)
    rows = [sketcher.registers_of(1, np.zeros((w > 0).sum(), int), elements[w > 0], w[w > 0])[0] for w in (a, b)]
    assert abs((rows[0] == rows[1]).mean() - exact) < 4 * (exact * (1 - exact) / 4096) ** 0.5


def test_repeated_passage_keeps_the_band():
    """Pairs of set similarity above 0.8 where one text repeats a passage 50 times share a band."""
    shared = 0
    for i in range(60):
        passage = [f"p{i}x{j}" for j in range(20)]
        a = [f"w{i}x{j}" for j in range(104)]
        texts = [" ".join(a + passage), " ".join(a + passage * 50)]
        assert op.jaccard(*map(op.shingles, texts)) >= op.SIMILARITY
        (x, y), _ = op.Sketcher().bands(texts)
        shared += bool((x == y).any())
    assert shared >= 59
