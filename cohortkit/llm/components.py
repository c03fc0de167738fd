"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.session import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of every node to the least node around it: the larger ones, or the smaller ones."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = both if large else both.where(F.col("v") < F.col("u"))
    least = near.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("least"))
    tied = near.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = tied.where(F.col("v") > F.col("u")).select(F.col("least").alias("a"), F.col("v").alias("b"))
    else:
        moved = tied.select(F.col("least").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of the links (a, b) with the least node that it is linked to.

    Each round writes its links to the shared folder; the links end as stars around the least nodes. The
    number of rounds grows with the logarithm of the longest chain.
    """
    current = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = current.agg(mark.alias("m")).first().m
    while True:
        current = written(_stars(written(_stars(current, large=True), "links"), large=False), "links")
        after = current.agg(mark.alias("m")).first().m
        if after == before:
            break
        before = after
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
