"""Exact nearest vectors: clusters with centre and radius, pruned by the triangle inequality.

Vectors are scaled to length 1, so the largest cosine is the smallest distance. A query first measures the
members of its nearest clusters, which bounds the distance of its k-th neighbour. A cluster whose centre is
farther away than that bound and its radius together cannot hold a better one; all others are measured, block by
block as products of matrices, and each block gives the best of every query alone. What is left out is proved to
lose, so results equal those over all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortkit.session import ship_code, written

# Most clusters, and members of a cluster that one task measures.
MOST_CLUSTERS, PART_ROWS = 256, 4096
# Queries measured together, which bounds the arrays.
QUERY_ROWS = 256
# Room for rounding in comparisons of cosines, and of distances: near 0 these are roots of rounding errors.
SLACK, DISTANCE_SLACK = 1e-9, 1e-6
# The distance of vectors of different lengths, as far as vectors of length 1 can be.
FARTHEST = 2.0


def dot(a: Column, b: Column) -> Column:
    """Sum of products in the order of the components, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda done, x: done + x)


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit) of the vectors that have a direction; null, zero and non-finite ones go."""
    given = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    # The norm is bound as a variable: as a column the optimizer would put its sum into the division of each component.
    unit = F.transform(F.array(norm), lambda n: F.when((n > 0) & (n < math.inf), F.transform("v", lambda x: x / n)))[0]
    return given.where(F.col("v").isNotNull() & ~bad).select("id", unit.alias("unit")).where(F.col("unit").isNotNull())


def distance(a: Column, b: Column) -> Column:
    """Of two vectors of length 1; ``FARTHEST`` if they differ in their number of components."""
    near = F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * dot(a, b)))
    return F.when(F.size(a) == F.size(b), near).otherwise(F.lit(FARTHEST))


def centres(units: DataFrame, clusters: int) -> DataFrame:
    """One row with ``all``: up to ``clusters`` vectors drawn by a hash of their ids, numbered."""
    drawn = units.select(F.xxhash64(F.lit("centre"), "id").alias("_h"), "unit").orderBy("_h").limit(clusters)
    listed = drawn.agg(F.array_sort(F.collect_list(F.struct("_h", "unit"))).alias("c"))
    return listed.select(F.transform("c", lambda x, i: F.struct(i.alias("cluster"), x["unit"].alias("centre"))).alias("all"))


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of vectors: their rows, and the vectors as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    out = {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out[size] = rows, values[begins[rows][:, None] + np.arange(size)]
    return out


def nearest_centre(vectors: dict[int, tuple[np.ndarray, np.ndarray]], middles: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest centre of ``n`` vectors; ties go to the smaller number."""
    cluster, away = np.zeros(n, np.int32), np.full(n, FARTHEST)
    for size, (rows, matrix) in vectors.items():
        same = [i for i, m in enumerate(middles) if len(m) == size]
        if same:
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (matrix @ np.array([middles[i] for i in same]).T)))
            first = gap.argmin(1)
            cluster[rows], away[rows] = np.array(same, np.int32)[first], gap[np.arange(len(rows)), first]
    return cluster, away


def best_of_block(q: np.ndarray, floor: np.ndarray, own: np.ndarray, units: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, unit row, score) of the ``k`` largest cosines of every query that reach its floor, ties to smaller ids.

    ``own`` and ``ids`` are numbers; equal ones are left out. A product of matrices finds what can be among the
    best; scores are then summed in the order of the components, as ``dot`` does.
    """
    rough = q @ units.T
    rough[own[:, None] == ids[None, :]] = -math.inf
    least = np.partition(rough, -k, 1)[:, -k] if k < rough.shape[1] else np.full(len(q), -math.inf)
    row, col = np.nonzero((rough >= np.maximum(least, floor)[:, None] - SLACK) & (rough > -math.inf))
    score = np.zeros(len(row))
    for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(units.T)):
        score += a[row] * b[col]
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], score[place < k]


def assign(units: DataFrame, clusters: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, clusters): every vector with its nearest centre and the distance; centres with radius and size.

    The centres are at most ``MOST_CLUSTERS`` vectors: no join, no shuffle of vectors.
    """
    if clusters is None:
        clusters = min(MOST_CLUSTERS, max(1, math.isqrt(units.count())))
    drawn = written(centres(units, clusters), "centres")
    # At most MOST_CLUSTERS vectors, which go to the workers with the code.
    middles = [np.array(c["centre"], float) for c in (drawn.first()["all"] or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, away = nearest_centre(by_length(batch.column(1)), middles, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(away)], ["id", "unit", "cluster", "away"])

    ship_code(units.sparkSession)
    members = written(units.mapInArrow(run, StructType([*units.schema.fields]).add("cluster", "integer").add("away", "double")), "members")
    sizes = members.groupBy("cluster").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("size"))
    listed = drawn.select(F.inline("all")).join(sizes, "cluster")
    return members, listed.withColumn("parts", F.ceil(F.col("size") / PART_ROWS).cast("int"))


def _measure(pairs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """query, id, score: of every cluster asked, in parts, the ``k`` best members for the query that reach its floor.

    A large cluster is dealt over parts by id, and the queries that want it go to every part.
    """
    parted = members.join(pairs.select("cluster", "parts").distinct(), "cluster").select("id", "unit", "cluster", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    asked = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query", "q", "own", "floor", "cluster", "part")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, ids = left.column("query").combine_chunks(), right.column("id").combine_chunks()
        # Ids of any type as numbers in their order; a query's own id that is none of them is -1.
        numbers = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        place = pc.index_in(left.column("own").combine_chunks(), value_set=ids, skip_nulls=True).fill_null(-1).to_numpy()
        own = np.where(place < 0, -1, numbers[place])
        floor = left.column("floor").fill_null(-math.inf).to_numpy()
        met, units = by_length(right.column("unit")), by_length(left.column("q"))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for size in met.keys() & units.keys():
            (rows, q), (held, unit) = units[size], met[size]
            for i in range(0, len(rows), QUERY_ROWS):
                some = rows[i : i + QUERY_ROWS]
                row, col, score = best_of_block(q[i : i + QUERY_ROWS], floor[some], own[some], unit, numbers[held], k)
                found.append((some[row], held[col], score))
        row, col, score = (np.concatenate(x) for x in zip(*found))
        return pa.table([queries.take(pa.array(row)), ids.take(pa.array(col)), pa.array(score)], ["query", "id", "score"])

    ship_code(members.sparkSession)
    made = StructType([pairs.schema["query"], members.schema["id"]]).add("score", "double")
    return asked.groupBy("cluster", "part").cogroup(parted.groupBy("cluster", "part")).applyInArrow(run, made)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False, clusters: int | None = None
) -> DataFrame:
    """query, rank, id, score: the ``k`` vectors of largest cosine for every query, ties to smaller ids.

    ``queries`` has the same columns; with ``skip_self`` a vector with the query's own id is left out. A
    vector without direction takes no part. See ``pruned_share`` for how much work the clusters save.
    """
    found, _, _ = _search(vectors, queries, k, id_col, vector_col, skip_self, clusters)
    return found


def pruned_share(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int | None = None) -> float:
    """The share of all pairs that the bounds rule out before they are measured."""
    _, asked, all_pairs = _search(vectors, queries, k, id_col, vector_col, False, clusters)
    pairs = all_pairs.first()
    total = (pairs[0] or 0) * (pairs[1] or 0)
    return 1 - (asked.agg(F.sum("size")).first()[0] or 0) / total if total else 0.0


def _search(vectors, queries, k, id_col, vector_col, skip_self, clusters):
    members, listed = assign(written(unit_vectors(vectors, id_col, vector_col), "units"), clusters)
    asked = unit_vectors(queries, id_col, vector_col).select(F.col("id").alias("query"), F.col("unit").alias("q"))
    asked = asked.withColumn("own", F.col("query") if skip_self else F.lit(None).cast(asked.schema["query"].dataType))
    table = listed.agg(F.collect_list(F.struct("cluster", "centre", "radius", "size", "parts")).alias("all"))
    away = F.transform(
        "_clusters",
        lambda c: F.struct(distance(F.col("q"), c["centre"]).alias("to_centre"), c["cluster"].alias("cluster"), c["radius"].alias("radius"), c["size"].alias("size"), c["parts"].alias("parts")),
    )
    ranked = asked.withColumn("_clusters", table.scalar()).withColumn("_all", F.array_sort(away))
    # The nearest clusters that together hold k other vectors for certain give the bound.
    needed = k + (1 if skip_self else 0)
    taken = F.aggregate(
        "_all",
        F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("clusters")),
        lambda s, c: F.when(s["held"] >= needed, s).otherwise(F.struct((s["held"] + c["size"]).alias("held"), (s["clusters"] + 1).alias("clusters"))),
    )
    ranked = written(ranked.withColumn("_first", taken["clusters"]).select("query", "q", "own", "_first", "_all"), "queries")
    parts = ["c.cluster", "c.size", "c.parts"]
    first = ranked.select("query", "q", "own", F.explode(F.slice("_all", F.lit(1), F.col("_first"))).alias("c")).select("query", "q", "own", *parts, F.lit(None).cast("double").alias("floor"))
    near = written(_measure(first, members, k), "near")
    # The k-th cosine is the floor, and gives the bound of the distance; a query without k neighbours has neither.
    floors = _best(near, k).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    bound = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("floor"))), F.lit(2 * FARTHEST))
    others = ranked.join(floors, "query", "left").select("query", "q", "own", "floor", bound.alias("bound"), F.explode(F.slice("_all", F.col("_first") + 1, F.size("_all"))).alias("c"))
    reach = others.where(F.col("c.to_centre") - F.col("c.radius") <= F.col("bound") + DISTANCE_SLACK).select("query", "q", "own", *parts, "floor")
    rest = _measure(reach, members, k)
    found = _best(near.unionByName(rest), k).select("query", "rank", "id", "score")
    sizes = members.agg(F.count(F.lit(1)).alias("n")).select("n", ranked.agg(F.count(F.lit(1))).scalar().alias("queries"))
    return found, first.unionByName(reach), sizes
