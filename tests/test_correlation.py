import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import correlation as op


@pytest.fixture(scope="module")
def frame():
    dice = random.Random(1)
    rows = [(dice.choice(["x", "y", None]), dice.choice(["red", "blue", "green", None]), None if dice.random() < 0.2 else dice.gauss(5, 2), dice.randint(0, 9), 1e9 + dice.random()) for _ in range(500)]
    return pd.DataFrame(rows, columns=["part", "colour", "a", "b", "far"])


def given(spark, frame):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "part string, colour string, a double, b int, far double").repartition(4)


def as_table(df):
    return {(r.a, r.b): (r.n, None if r.corr is None else round(r.corr, 6)) for r in df.collect()}


def test_matrix_with_categories(spark, frame):
    coded = frame.drop(columns="part").copy()
    coded["colour"] = coded["colour"].astype("category").cat.codes.astype(float).where(coded["colour"].notna())
    want = coded.corr()
    got = as_table(op.correlation_matrix(given(spark, frame), ["a", "b", "far"], ["colour"]))
    # Values near 1e9 hold seven digits of their spread.
    assert {k: v[1] for k, v in got.items()} == {(x, y): pytest.approx(want.loc[x, y], abs=2e-6) for x in want for y in want}
    assert got["a", "colour"][0] == (frame["a"].notna() & frame["colour"].notna()).sum()


def test_codes_follow_the_order_of_values(spark):
    rows = [(f"v{i % 700:03d}", "z" if i % 2 else "é") for i in range(3000)] + [(None, None)]
    got = op.category_codes(spark.createDataFrame(rows, "p string, q string").repartition(6), ["p", "q"]).collect()
    assert sorted((r.column, r.value, r.code) for r in got) == [("p", f"v{i:03d}", i) for i in range(700)] + [("q", "z", 0), ("q", "é", 1)]


def test_moments_merge(spark, frame):
    data = given(spark, frame).withColumn("part", F.coalesce("part", F.lit("none")))
    by_part = op.co_moments(data, ["a", "b", "far"], by=["part"])
    merged = as_table(op.correlation(op.merge_moments(by_part.drop("part"))))
    assert merged == as_table(op.correlation(op.co_moments(data, ["a", "b", "far"])))
    per_part = op.correlation(by_part, by=["part"]).where("part = 'x' AND a = 'a' AND b = 'b'").first()
    want = frame[frame["part"] == "x"][["a", "b"]].corr().iloc[0, 1]
    assert per_part.corr == pytest.approx(want)


def test_constants_nan_and_wrong_types(spark):
    rows = [(1.0, 5.0, True), (2.0, 5.0, False), (float("nan"), 5.0, None), (None, 5.0, True)]
    data = spark.createDataFrame(rows, "x double, c double, f boolean")
    got = as_table(op.correlation(op.co_moments(data, ["x", "c", "f"])))
    assert got["x", "x"] == (2, 1.0) and got["x", "c"] == (2, None) and got["f", "x"] == (2, -1.0)
    assert as_table(op.correlation(op.co_moments(data.limit(0), ["x", "c"])))["x", "c"] == (0, None)
    empty = op.co_moments(data.limit(0), ["x", "c"]).unionByName(op.co_moments(data, ["x", "c"]))
    assert as_table(op.correlation(op.merge_moments(empty)))["x", "x"] == (2, 1.0)
    with pytest.raises(ValueError):
        op.co_moments(spark.createDataFrame([("a",)], "s string"), ["s"])
