"""Approximate nearest neighbours: a graph by NN-descent, searched greedily from many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import ship_code, written

# Neighbours of a node; orders of the start, rows of a block of an order, bits of its signature, neighbours kept per block.
DEGREE, ORDERS, BLOCK, BITS, START = 32, 6, 384, 40, 12
# NN-descent ends after so many rounds, or when fewer neighbours than this share have changed.
ROUNDS, CHANGED = 5, 0.01
# Nodes a search keeps per query, nodes it visits per step, steps at most.
BEAM, VISITS, STEPS = 160, 32, 16
# Members of one meeting besides the centre's own neighbours; centres or nodes that share a block of work.
PART, TOGETHER = 32, 512


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, as doubles: not null, not zero, all components finite."""
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col(id_col).alias("id"), values.alias("vector"))
        .where(F.col("id").isNotNull() & F.col("vector").isNotNull())
        .where(finite & F.exists("vector", lambda x: x != 0))
    )


def _pack(vector: Column) -> Column:
    """The vector at length 1 as bytes of 32-bit floats."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([_unit(np.asarray(v, float)).astype("<f4").tobytes() for v in batch], dtype=object)

    return F.pandas_udf(run, "binary")(vector)


def _unit(v: np.ndarray) -> np.ndarray:
    """At length 1; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


@dataclass
class Graph:
    """Written tables: nodes (node, unit), members (node, id, vector), edges (node, unit, near: array of (score, node))."""

    nodes: DataFrame
    members: DataFrame
    edges: DataFrame
    mean: np.ndarray
    dim: int


def _signed(rows: DataFrame, mean: np.ndarray, seed: int = 7) -> DataFrame:
    """One row per order with ``sign``: the signs of random projections, so that sorting by it is a walk through a random tree."""
    planes = np.random.default_rng(seed).standard_normal((ORDERS, BITS, len(mean)))

    def run(units: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(units), "<f4").reshape(len(units), -1) - mean
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        signs = [(x @ p.T > 0) @ powers for p in planes]
        return pd.Series(list(np.stack(signs, axis=1)))

    signs = F.pandas_udf(run, "array<bigint>")("unit")
    return rows.select("*", F.posexplode(signs).alias("order", "sign"))


def _merge_near(found: DataFrame, size: int) -> DataFrame:
    """(id, near): the ``size`` best distinct (score, node) per id of (id, other, score), nearest first.

    All rows of an id meet once; they are few, as every source hands on its best ones only.
    """
    best = found.repartition("id").groupBy("id", "other").agg(F.max("score").alias("score"))
    pair = F.struct(F.col("score"), (-F.col("other")).alias("behind"))
    listed = best.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(pair), asc=False), 1, size).alias("near"))
    return listed.select("id", F.transform("near", lambda x: F.struct(x["score"].alias("score"), (-x["behind"]).alias("node"))).alias("near"))


def _blocks(rows: DataFrame, keep: int, queries: bool) -> DataFrame:
    """(id, other, score): the nearest ``keep`` nodes of the same block for nodes, or for queries.

    Rows are (node, unit, query, order, sign). A block is ``BLOCK`` rows that follow each other in an order, so
    it is bounded even if a third of the rows lie in one place.
    """
    ranged = rows.repartitionByRange("order", "sign", F.xxhash64("node", "query")).sortWithinPartitions("order", "sign", F.xxhash64("node", "query"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            full = len(rest) // BLOCK * BLOCK
            if full > BLOCK:
                yield from (near(rest.iloc[i : i + BLOCK]) for i in range(0, full - BLOCK, BLOCK))
                rest = rest.iloc[full - BLOCK :]
        if rest is not None:
            for i in range(0, len(rest), BLOCK):
                # A short last block borrows the rows before it.
                yield near(rest.iloc[max(0, min(i, len(rest) - BLOCK)) : i + BLOCK])

    def near(block: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(block["unit"]), "<f4").reshape(len(block), -1)
        is_query = block["query"].to_numpy()
        asks, gives = np.flatnonzero(is_query == queries), np.flatnonzero(~is_query)
        scores = x[asks] @ x[gives].T
        names = block["node"].to_numpy()
        if not queries:
            np.fill_diagonal(scores, -np.inf)
        k = min(keep, len(gives) - (not queries))
        if k <= 0 or not len(asks):
            return pd.DataFrame({"id": [], "other": [], "score": []})
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"id": np.repeat(names[asks], k), "other": names[gives][top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel()})

    return ranged.select("node", "unit", "query", "order", "sign").mapInPandas(run, "id bigint, other bigint, score float")


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Graph:
    """Index every vector that takes part. Runs jobs when called.

    Equal vectors are one node, named by the least id. Vectors of another length than the most frequent one
    (the shorter in a tie) take no part. Ids are bigint.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    given = clean(vectors, id_col, vector_col).withColumn("id", F.col("id").cast("bigint"))
    lengths = given.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").first()
    dim = lengths.dim if lengths else 1
    rows = written(given.where(F.size("vector") == dim).distinct(), "vectors")
    groups = rows.groupBy("vector").agg(F.min("id").alias("node"))
    nodes = written(groups.select("node", _pack(F.col("vector")).alias("unit")), "nodes")
    members = written(rows.join(groups, "vector").select("node", "id", "vector"), "members")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            total += np.frombuffer(b"".join(batch["unit"]), "<f4").reshape(-1, dim).sum(axis=0)
            n += len(batch)
        yield pd.DataFrame({"at": np.arange(dim), "sum": total, "n": n})

    sums = nodes.select("unit").mapInPandas(add, "at int, sum double, n bigint").groupBy("at").agg(F.try_divide(F.sum("sum"), F.sum("n")).alias("mean")).orderBy("at").collect()
    mean = np.array([r["mean"] or 0.0 for r in sums]) if sums else np.zeros(dim)

    signed = _signed(nodes.withColumn("query", F.lit(False)), mean)
    start = _merge_near(_blocks(signed, START, queries=False), DEGREE)
    # The place of a node in the first order, from 0 to 1, by its signature.
    place = signed.where("order = 0").select(F.col("node").alias("id"), "unit", (F.col("sign") / float(2**BITS)).alias("place"))
    edges = written(start.join(place, "id").select(F.col("id").alias("node"), "unit", "near", F.transform("near", lambda x: F.lit(True)).alias("fresh"), "place"), "edges")
    total = max(1, nodes.count())
    for _ in range(ROUNDS):
        edges, changed = _descend(edges, total)
        if changed < CHANGED * DEGREE * total:
            break
    return Graph(nodes, members, edges, mean, dim)


def _descend(edges: DataFrame, total: int) -> tuple[DataFrame, int]:
    """One round: the neighbours of every node meet, and each keeps the nearest it has met.

    A centre's neighbours are those it lists and those that list it. The latter are dealt into parts of about
    ``PART``, so a node that very many others list makes many small meetings. Meetings without a neighbour
    that came in the last round are skipped, as all their pairs have met. About ``TOGETHER`` meetings of
    centres that lie close in the first order share a block of work, to which each vector comes once.
    """
    blocks = -(-total // TOGETHER)
    listed = edges.select("node", "place", F.explode(F.arrays_zip("near", "fresh")).alias("x")).select("node", "place", F.col("x.near.node").alias("other"), F.col("x.fresh").alias("fresh"))
    degrees = listed.groupBy(F.col("other").alias("centre")).agg((F.floor((F.count(F.lit(1)) - 1) / PART) + 1).alias("parts"))
    # Both ways at once, so that they meet the degrees in one join; only the centre's own rows tell its place.
    ways = F.array(
        F.struct(F.col("node").alias("centre"), F.col("other").alias("member"), F.lit(True).alias("own"), "place"),
        F.struct(F.col("other").alias("centre"), F.col("node").alias("member"), F.lit(False).alias("own"), F.lit(None).cast("double").alias("place")),
    )
    both = listed.select(F.explode(ways).alias("x"), "fresh").select("x.*", "fresh").join(degrees, "centre", "left")
    last = F.coalesce("parts", F.lit(1).cast("bigint")) - 1
    dealt = F.when(F.col("own"), F.sequence(F.lit(0).cast("bigint"), last)).otherwise(F.array(F.pmod(F.xxhash64("member"), last + 1)))
    met = both.select("centre", F.explode(dealt).alias("part"), "member", "fresh", "place").repartition("centre", "part")
    once = met.groupBy("centre", "part", "member").agg(F.max("fresh").alias("fresh"), F.max("place").alias("place"))
    lists = once.groupBy("centre", "part").agg(F.collect_list("member").alias("members"), F.collect_list("fresh").alias("fresh"), F.max("fresh").alias("any"), F.max("place").alias("place"))
    block = F.pmod(F.floor(F.col("place") * blocks) + F.col("part") * 7919, F.lit(blocks)).cast("int")
    meetings = written(lists.where("any AND place IS NOT NULL").select(block.alias("block"), "members", "fresh"), "meetings")
    state = edges.select(F.col("node").alias("member"), "unit", F.when(F.size("near") >= DEGREE, F.element_at("near", -1)["score"]).alias("worst"))
    guests = meetings.select(F.col("block").alias("home"), F.explode("members").alias("member")).distinct().join(state, "member")

    def run(meet: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        if not len(meet):
            return pd.DataFrame({"id": [], "other": [], "score": []})
        guest = guest.sort_values("member")
        names = guest["member"].to_numpy()
        units = np.frombuffer(b"".join(guest["unit"]), "<f4").reshape(len(guest), -1)
        floor = guest["worst"].fillna(-np.inf).to_numpy(np.float32)
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.float32)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for i, (members, fresh) in enumerate(zip(meet["members"], meet["fresh"])):
            at = np.searchsorted(names, np.asarray(members, np.int64))
            new = np.asarray(fresh, bool)
            x = units[at]
            scores = x @ x.T
            wanted = (scores > floor[at][:, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(wanted, False)
            a, b = np.nonzero(wanted)
            pending.append((at[a] * np.int64(len(names)) + at[b], scores[a, b]))
            size += len(a)
            if size > 2_000_000 or i == len(meet) - 1:
                keys, values = _best(np.concatenate([keys, *(p[0] for p in pending)]), np.concatenate([values, *(p[1] for p in pending)]), len(names))
                pending, size = [], 0
        return pd.DataFrame({"id": names[keys // len(names)], "other": names[keys % len(names)], "score": values})

    grouped = meetings.groupBy("block").cogroup(guests.groupBy("home"))
    found = written(grouped.applyInPandas(run, "id bigint, other bigint, score float"), "found")
    old = edges.select(F.col("node").alias("id"), F.explode("near").alias("x")).select("id", F.col("x.node").alias("other"), F.col("x.score").alias("score"))
    merged = _merge_near(old.unionByName(found), DEGREE)
    before = edges.select(F.col("node").alias("id"), "unit", F.transform("near", lambda x: x["node"]).alias("had"), "place")
    marked = merged.join(before, "id", "left").select(
        F.col("id").alias("node"), "unit", "near", F.transform("near", lambda x: ~F.coalesce(F.array_contains("had", x["node"]), F.lit(False))).alias("fresh"), "place"
    )
    result = written(marked, "edges")
    changed = result.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("n")).first().n or 0
    return result, changed


def _best(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (asker * n + other), the ``DEGREE`` of largest value per asker."""
    keys, first = np.unique(keys, return_index=True)
    values = values[first]
    order = np.lexsort((-values, keys // n))
    keys, values = keys[order], values[order]
    asker = keys // n
    starts = np.flatnonzero(np.concatenate([[True], asker[1:] != asker[:-1]])) if len(keys) else np.zeros(0, np.int64)
    rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    return keys[rank < DEGREE], values[rank < DEGREE]


def search(graph: Graph, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False) -> DataFrame:
    """The nearest ``k`` rows found for every query: query_id, rank (from 1), vec_id, score (cosine in doubles).

    A query starts at the nodes of its own blocks, then visits the neighbours of the best nodes it has, over
    and over, until no visit brings a better one. Ties go to the smaller id. Queries that are null, zero, not
    finite or of another length get no rows; query ids must be unique. With ``skip_self`` the row with the
    query's own id is no answer. Fewer rows come back only when the graph holds fewer.
    """
    spark = queries.sparkSession
    ship_code(spark)
    asked = clean(queries, id_col, vector_col).where(F.size("vector") == graph.dim).select(F.col("id").cast("bigint").alias("id"), "vector").dropDuplicates(["id"])
    asked = written(asked.withColumn("unit", _pack(F.col("vector"))), "queries")
    both = graph.nodes.select("node", "unit", F.lit(False).alias("query")).unionByName(asked.select(F.col("id").alias("node"), "unit", F.lit(True).alias("query")))
    entry = _blocks(_signed(both, graph.mean), START, queries=True)
    none = F.array().cast("array<bigint>")
    beam = _stepped(_merge_near(entry, BEAM).join(asked.select("id", "unit"), "id").withColumn("visited", none))
    forth = graph.edges.select("node", F.explode("near").alias("x")).select("node", F.col("x.node").alias("other"))
    ways = written(forth.unionByName(forth.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "ways")
    blocks = -(-max(1, graph.nodes.count()) // TOGETHER)
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    homes = written(graph.nodes.select(block, "node", "unit"), "homes")
    for _ in range(STEPS):
        front = beam.select("id", F.explode("next").alias("node"))
        if front.isEmpty():
            break
        reached = front.join(ways, "node").select("id", F.col("other").alias("node"))
        found = _scores(reached.select("id", "node", block), beam, homes)
        best = found.groupBy("id").agg(F.collect_list(F.struct("score", (-F.col("other")).alias("behind"))).alias("found"))
        # What was found is not in the beam yet, and no node is found twice.
        held = F.transform("near", lambda x: F.struct(x["score"].alias("score"), (-x["node"]).alias("behind")))
        joined = beam.join(best, "id", "left").withColumn("all", F.when(F.col("found").isNull(), held).otherwise(F.concat(held, "found")))
        near = F.transform(F.slice(F.sort_array("all", asc=False), 1, BEAM), lambda x: F.struct(x["score"].alias("score"), (-x["behind"]).alias("node")))
        beam = _stepped(joined.select("id", "unit", near.alias("near"), "visited"))

    few = Window.partitionBy("node").orderBy("id")
    # k + 1 least ids of a node are enough: they tie, and one may be the query itself.
    given = graph.members.withColumn("_at", F.row_number().over(few)).where(F.col("_at") <= k + 1).select("node", F.col("id").alias("vec_id"), F.col("vector").alias("b"))
    candidates = beam.select("id", F.explode(F.transform("near", lambda x: x["node"])).alias("node")).join(given, "node").join(asked.select("id", F.col("vector").alias("a")), "id")
    if skip_self:
        candidates = candidates.where(F.col("id") != F.col("vec_id"))
    exact = candidates.select(F.col("id").alias("query_id"), "vec_id", F.pandas_udf(_cosines, "double")("a", "b").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _stepped(beam: DataFrame) -> DataFrame:
    """The beam (id, unit, near, visited) written with ``next``, the nodes to visit now, which count as visited."""
    nodes = F.transform("near", lambda x: x["node"])
    ahead = beam.withColumn("next", F.slice(F.array_except(nodes, F.col("visited")), 1, VISITS))
    return written(ahead.select("id", "unit", "near", F.array_union("visited", "next").alias("visited"), "next"), "beam")


def _scores(pairs: DataFrame, beam: DataFrame, homes: DataFrame) -> DataFrame:
    """(id, other, score) of pairs (id, node, block) new to the query's beam whose cosine is above its worst one so far.

    The vector of a query comes once to every block of nodes in which it has pairs.
    """
    worst = F.when(F.size("near") >= BEAM, F.element_at("near", -1)["score"])
    asking = beam.select("id", "unit", worst.alias("worst"), F.transform("near", lambda x: x["node"]).alias("held"))
    # Dealt by query, the pairs need no further shuffle to be grouped and to meet the queries.
    asked = pairs.repartition("id").groupBy("block", "id").agg(F.collect_set("node").alias("nodes")).join(asking, "id")
    visits = asked.select("block", "id", "unit", "worst", F.array_except("nodes", "held").alias("nodes")).where(F.size("nodes") > 0)

    def run(visit: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        if not len(visit):
            return pd.DataFrame({"id": [], "other": [], "score": []})
        home = home.sort_values("node")
        names = home["node"].to_numpy()
        units = np.frombuffer(b"".join(home["unit"]), "<f4").reshape(len(home), -1)
        ids, others, scores = [], [], []
        for query, unit, nodes, worst in zip(visit["id"], visit["unit"], visit["nodes"], visit["worst"]):
            at = np.searchsorted(names, np.asarray(nodes, np.int64))
            found = units[at] @ np.frombuffer(unit, "<f4")
            above = found > (-np.inf if worst is None or np.isnan(worst) else worst)
            ids.append(np.full(int(above.sum()), query, np.int64))
            others.append(names[at[above]])
            scores.append(found[above])
        return pd.DataFrame({"id": np.concatenate(ids), "other": np.concatenate(others), "score": np.concatenate(scores)})

    return visits.groupBy("block").cogroup(homes.groupBy("block")).applyInPandas(run, "id bigint, other bigint, score float")


def _cosines(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine in double precision on the original vectors."""
    out = []
    for x, y in zip(a, b):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if max(np.abs(x).max(), np.abs(y).max()) > 1e100 or min(np.abs(x).max(), np.abs(y).max()) < 1e-100:
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
        out.append(float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))))
    return pd.Series(out, dtype=float)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False) -> DataFrame:
    """``search`` of ``queries`` in a graph that is built over ``vectors``."""
    return search(build(vectors, id_col, vector_col), queries, k, id_col, vector_col, skip_self)
