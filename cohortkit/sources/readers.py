"""Scans: tables, queries, files, JDBC relations and local frames."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortkit.functions.frames import lower_columns


def resolve(spark: SparkSession, source: DataFrame | str, default_database: str | None = None) -> DataFrame | None:
    """A DataFrame as it is, the result of a SELECT or WITH query, or the named table.

    A table name without database is looked up in ``default_database`` when that exists, else in the
    current one. Anything but a DataFrame or string gives None.
    """
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        return None
    bare = re.sub(r"/\*.*?\*/", " ", source, flags=re.S)
    bare = re.sub(r"--[^\n]*", " ", bare).strip()
    if re.match(r"(select|with)\s", bare, flags=re.I):
        return spark.sql(source)
    name = bare.strip("`")
    if "." not in name:
        known = default_database and spark.catalog.databaseExists(default_database)
        name = f"{default_database if known else spark.catalog.currentDatabase()}.{name}"
    return spark.table(name)


def jdbc_options(
    url: str,
    dbtable: str,
    driver: str | None = None,
    user: str | None = None,
    password: str | None = None,
    fetchsize: int | None = None,
    session_init: str | None = None,
    partition_column: str | None = None,
    lower_bound=None,
    upper_bound=None,
    num_partitions: int | None = None,
) -> dict[str, str]:
    """Reader or writer options; unset arguments are left out."""
    split = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(v is not None for v in split) and any(v is None for v in split):
        raise ValueError("a partitioned read needs the column, both bounds and the number of partitions")
    options = {
        "url": url,
        "dbtable": dbtable,
        "driver": driver,
        "user": user,
        "password": password,
        "fetchsize": fetchsize,
        "sessionInitStatement": session_init,
        "partitionColumn": partition_column,
        "lowerBound": lower_bound,
        "upperBound": upper_bound,
        "numPartitions": num_partitions,
    }
    return {key: str(value) for key, value in options.items() if value is not None}


def read_jdbc(spark: SparkSession, url: str, dbtable: str, lowercase: bool = True, **options) -> DataFrame:
    """A JDBC table or ``(query) alias``. See :func:`jdbc_options` for parallel reads and fetch size."""
    df = spark.read.format("jdbc").options(**jdbc_options(url, dbtable, **options)).load()
    return lower_columns(df) if lowercase else df


def read_csv_dir(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    header: bool = True,
    pattern: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Delimited files, plain or compressed. Without a schema the types are inferred by a first pass.

    ``pattern`` picks files by name, such as ``*.csv.gz``.
    """
    reader = spark.read.options(sep=sep, header=header)
    reader = reader.schema(schema) if schema is not None else reader.options(inferSchema=True)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.csv(path)
    return df if partitions is None else df.coalesce(partitions)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All parquet files of one or more directories as one frame."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def _spark_type(dtype, as_date: bool) -> T.DataType:
    name = str(dtype)
    if name.startswith("datetime64"):
        return T.DateType() if as_date else T.TimestampType()
    return {"int64": T.LongType(), "int32": T.IntegerType(), "float64": T.DoubleType()}.get(name, T.StringType())


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, dates: Sequence[str] = ()) -> DataFrame:
    """A local frame with types set by dtype: integers, doubles, timestamps (dates when listed), text."""
    schema = T.StructType([T.StructField(str(c), _spark_type(t, c in dates)) for c, t in pdf.dtypes.items()])
    local = pdf.copy()
    for field in schema:
        if isinstance(field.dataType, T.StringType):
            local[field.name] = local[field.name].map(lambda v: None if pd.isna(v) else str(v)).astype(object)
        elif isinstance(field.dataType, T.DateType):
            local[field.name] = local[field.name].map(lambda v: None if pd.isna(v) else v.date()).astype(object)
    return spark.createDataFrame(local, schema)
