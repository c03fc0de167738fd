"""Small helpers on whole DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def match_column(df: DataFrame, name: str | None) -> str | None:
    """The column of ``df`` called ``name`` in any letter case, or None."""
    if name is None:
        return None
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def select_existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Those of the wanted columns that exist, in the frame's own order."""
    keep = set(wanted)
    return df.select([c for c in df.columns if c in keep])


def clean_code(value: Column | str, default: str = "z") -> Column:
    """One-letter code: a missing value becomes the default, blanks are trimmed."""
    code = F.col(value) if isinstance(value, str) else value
    return F.substring(F.trim(F.coalesce(code, F.lit(default))), 1, 1)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows found in exactly one of the two frames, with one shuffle."""
    columns = left.columns
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(columns).withColumn("_side", F.lit(2)))
    return (
        both.groupBy(*columns)
        .agg(F.min("_side").alias("_low"), F.max("_side").alias("_high"))
        .where(F.col("_low") == F.col("_high"))
        .select(columns)
    )


def to_pandas(df: DataFrame, partitions: int | None = None) -> pd.DataFrame:
    """Bring a small result to the driver through Arrow."""
    if partitions is not None:
        df = df.repartition(partitions)
    return df.toPandas()
