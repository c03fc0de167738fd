import random

from pyspark.sql import functions as F

from cohortkit.functions import bitmaps as op


def members(words):
    return {i * 64 + b for i, w in enumerate(words) for b in range(64) if w >> b & 1}


def test_sets_as_words(spark):
    dice = random.Random(3)
    assert [op.words_for(n) for n in (0, 1, 64, 65, 200)] == [1, 1, 1, 2, 4]
    rows = [(i, dice.randint(-3, 203), dice.randint(-3, 203)) for i in range(300)] + [(900, 0, 199), (901, 63, 64), (902, 64, 63), (903, None, 5), (904, 5, None), (905, -9, -2), (906, 200, 300)]
    data = spark.createDataFrame(rows, "i int, a int, z int")
    names = [f"w{j}" for j in range(4)]
    spans = data.select("i", *[w.alias(n) for n, w in zip(names, op.interval_words(F.col("a"), F.col("z"), 4))])
    want = {i: set() if a is None or z is None else set(range(max(a, 0), min(z, 255) + 1)) for i, a, z in rows}
    assert {r.i: members([w & 2**64 - 1 for w in r[1:]]) for r in spans.collect()} == want
    listed = spans.select("i", op.members(names, 256).alias("m")).collect()
    assert {r.i: sorted(r.m) for r in listed} == {i: sorted(m) for i, m in want.items()}
    # Unions, and what they have in common with a fixed set.
    mask = op.literal_words(range(0, 256, 3), 4)
    united = spans.groupBy((F.col("i") % 5).alias("g")).agg(*op.union(names))
    common = F.array(*[F.lit(w) for w in mask])
    got = {r.g: r.n for r in united.select("g", op.count_common(F.array(*names), common).alias("n")).collect()}
    assert got == {g: len(set().union(*[m for i, m in want.items() if i % 5 == g]) & set(range(0, 256, 3))) for g in range(5)}


def test_single_members(spark):
    data = spark.createDataFrame([(0,), (63,), (64,), (129,), (None,)], "m int")
    got = data.select("m", *op.member_words(F.col("m"), 3)).collect()
    assert {r[0]: members([w & 2**64 - 1 for w in r[1:]]) for r in got} == {0: {0}, 63: {63}, 64: {64}, 129: {129}, None: set()}
    assert members([w & 2**64 - 1 for w in op.literal_words([0, 63, 64], 2)]) == {0, 63, 64}
