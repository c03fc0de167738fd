"""Correlation of many columns at once, categories coded by a dictionary table.

The state is a table of co-moments, one row per pair of columns: rows where both are known, their means and
their sums of squares and products about the means. It comes from one pass over the data, and tables of
several loads or partitions merge into one without reading the data again.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from cohortkit.session import written

MOMENTS = ("n", "mean_a", "mean_b", "square_a", "square_b", "product")


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The dictionary: column, value (as text), code. Codes count from 0 in the order of the values' bytes.

    Values are put in order by ranges, so also a column with very many of them is not ranked by one task.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    ranged = values.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    placed = written(ranged.withColumn("_part", F.spark_partition_id()), "categories")
    inside = F.row_number().over(Window.partitionBy("column", "_part").orderBy("value")) - 1
    before = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and column.
    base = placed.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_n")).select("column", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.withColumn("_at", inside).join(base, ["column", "_part"]).select("column", "value", (F.col("_at") + F.col("_base")).alias("code"))


def code_categories(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the codes in place of the categories; a value that the dictionary lacks becomes null."""
    for c in columns:
        own = codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = df.join(own, F.col(c).cast("string") == F.col("_value"), "left").withColumn(c, F.col("_code")).drop("_value", "_code")
    return df


def _moments(a: Column, b: Column) -> list[Column]:
    # A value counts where both are known; NaN counts as unknown.
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    x, y = F.when(known, a), F.when(known, b)
    n = F.count(x)
    return [n, F.avg(x), F.avg(y), F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n]


def co_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, a, b and ``MOMENTS`` for every pair of columns, in one aggregation with partial sums per task.

    Columns are numbers or flags; others need ``code_categories`` first. A group without a row where both
    are known has n = 0 and null moments.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        if not isinstance(types[c], NumericType | BooleanType):
            raise ValueError(f"column {c!r} must hold numbers; code categories first")
    numbers = {c: (F.col(c).cast("int") if isinstance(types[c], BooleanType) else F.col(c)).cast("double") for c in columns}
    pairs = list(combinations_with_replacement(columns, 2))
    aggregates = [m.alias(f"_{i}_{name}") for i, (a, b) in enumerate(pairs) for name, m in zip(MOMENTS, _moments(numbers[a], numbers[b]))]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(f"_{i}_{name}").alias(name) for name in MOMENTS]) for i, (a, b) in enumerate(pairs)]
    wide = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    return wide.select(*by, F.inline(F.array(*rows)))


def merge_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Co-moments of all rows from co-moments of disjoint parts: union the tables, then merge them."""
    keys = [*by, "a", "b"]
    group = Window.partitionBy(*keys)
    total = F.sum("n").over(group)
    centred = moments.where(F.col("n") > 0).withColumns(
        {f"_{c}": F.sum(F.col(c) * F.col("n")).over(group) / total for c in ("mean_a", "mean_b")}
    )
    off_a, off_b = F.col("mean_a") - F.col("_mean_a"), F.col("mean_b") - F.col("_mean_b")
    merged = centred.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("_mean_a").alias("mean_a"),
        F.first("_mean_b").alias("mean_b"),
        F.sum(F.col("square_a") + F.col("n") * off_a * off_a).alias("square_a"),
        F.sum(F.col("square_b") + F.col("n") * off_b * off_b).alias("square_b"),
        F.sum(F.col("product") + F.col("n") * off_a * off_b).alias("product"),
    )
    # Pairs that are known together nowhere stay in the table.
    every = moments.select(*keys).distinct()
    return every.join(merged, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).select(*keys, *MOMENTS)


def correlation(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, a, b, n, corr: both halves of the matrix and its diagonal; null where a column does not vary."""
    spread = F.sqrt(F.col("square_a")) * F.sqrt(F.col("square_b"))
    value = F.when((F.col("n") > 1) & (spread > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("product") / spread)))
    upper = moments.select(*by, "a", "b", "n", value.alias("corr"))
    sides = [F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "n", "corr") for x, y in (("a", "b"), ("b", "a"))]
    return upper.select(*by, F.inline(F.when(F.col("a") == F.col("b"), F.array(sides[0])).otherwise(F.array(*sides))))


def correlation_matrix(df: DataFrame, columns: Sequence[str], categories: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Correlation of all pairs of ``columns`` and ``categories``, the latter by their codes; see ``correlation``."""
    names = [*columns, *categories]
    given = df.select(*by, *names)
    if categories:
        given = code_categories(given, category_codes(given, categories), categories)
    return correlation(co_moments(given, names, by), by)
