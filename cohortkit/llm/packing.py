"""Packing token sequences to a target mixture of sources by deficit round-robin."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm import words
from cohortkit.session import ship_code, written

WINDOW = 4096
# Tokens a queue hands over at once: the most by which a source is ahead of or behind its share.
PACKET = 1024
# Fixed value of the contract: the id that ends a document.
END = 2
# Rows of a slice of a queue, rounds of a slice of the stream, slices of a block of slices, texts encoded at once.
SLICE_ROWS, SLICE_ROUNDS, BLOCK, BATCH = 1024, 64, 1024, 256


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A written table (id, source, tokens, n, row): little-endian ids of a text and its end.

    ``tokens`` has two bytes an id while the vocabulary allows it, else four; ``row`` numbers the rows.
    """
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words.load(path)
        end = np.array([END], coder.dtype).tobytes()
        for batch in batches:
            # Only the texts of a part are strings of Python at a time.
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = coder.encode_batch(part.column("text").to_pylist())
                tokens, n = pa.array([x.tobytes() + end for x in ids], pa.binary()), pa.array([len(x) + 1 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source"), tokens, n], names=["id", "source", "tokens", "n"])

    given = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    made = given.mapInArrow(run, f"id {id_type}, source string, tokens binary, n bigint")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "tokens")


def bases(totals: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """Add ``base``, the sum of ``value`` in the slices before each one, by blocks of slices."""
    by = list(by)
    blocked = totals.withColumn("_block", F.floor(F.col(at) / BLOCK))
    sums = blocked.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    before = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("_block") == F.col("_b")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = blocked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    renamed = before.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_block").alias("_b"), "_before")
    return placed.join(renamed, match).select(*totals.columns, (F.col("_in") + F.col("_before")).alias("base"))


def _quantum(source: Column, total: Column, everything: int, window: int, targets: dict[str | None, float] | None) -> Column:
    """Tokens a source earns per round: its target share of a window, else its share of all tokens."""
    natural = total / F.lit(float(max(everything, 1)))
    if targets is None:
        return natural * window
    share = F.lit(None).cast("double")
    for name, weight in targets.items():
        share = F.when(source.eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    return F.coalesce(share, natural) * window


def layout(tokens: DataFrame, window: int = WINDOW, packet: int = PACKET, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of the rows of ``tokenize``.

    In every round each queue earns its quantum and sends packets while its deficit covers them. While queues
    last, the packet that ends at token e of its queue thus leaves in round ceil(e / quantum), whatever the
    other queues do: what is left of the quantum carries over rounds, windows and partitions by itself. The
    stream of packets, by round and source, is cut into windows, so only the last one can be short. When a
    queue with a target share ends, the others go on.
    """
    meta = tokens.select("row", "source", "n", F.xxhash64("id", "row").alias("h"))
    size = meta.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    slices = max(1, math.ceil(size.rows / SLICE_ROWS))
    placed = meta.withColumn("slice", F.pmod(F.col("h"), F.lit(slices)))
    totals = placed.groupBy("source", "slice").agg(F.sum("n").alias("n"))
    per_source = totals.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("_total"))
    starts = bases(totals, ["source"], "slice", "n").join(per_source, F.col("source").eqNullSafe(F.col("_s")))
    quanta = starts.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), "base", _quantum(F.col("source"), F.col("_total"), size.tokens, window, targets).alias("quantum"))
    within = Window.partitionBy("source", "slice").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    queued = (
        placed.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(quanta, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
        .select("row", "source", "n", (F.col("base") + F.col("_in")).alias("queue_start"), "quantum")
    )
    packets = queued.select(
        "row", "source", "quantum", "queue_start", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(packet).cast("bigint"))).alias("start")
    ).withColumn("length", F.least(F.lit(packet), F.col("n") - F.col("start")).cast("bigint"))
    end = F.col("queue_start") + F.col("start") + F.col("length")
    rounds = written(packets.select("row", "source", "start", "length", end.alias("queue_end"), F.ceil(end / F.col("quantum")).alias("round")).withColumn("part", F.floor(F.col("round") / SLICE_ROUNDS)), "packets")

    parts = bases(rounds.groupBy("part").agg(F.sum("length").alias("n")), [], "part", "n").select(F.col("part").alias("_part"), "base")
    order = Window.partitionBy("part").orderBy("round", "source", "queue_end").rowsBetween(Window.unboundedPreceding, -1)
    stream = rounds.withColumn("_in", F.coalesce(F.sum("length").over(order), F.lit(0))).join(parts, F.col("part") == F.col("_part"))
    at = (F.col("base") + F.col("_in")).alias("at")
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window)
    cut = stream.select("row", "start", "length", at).withColumn("sequence_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("at"), F.col("sequence_id") * window)
    high = F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return cut.select(
        "row",
        (F.col("start") + low - F.col("at")).alias("start"),
        (high - low).alias("length"),
        "sequence_id",
        (low - F.col("sequence_id") * window).alias("offset"),
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, packet: int = PACKET, targets: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: ``id_col``, source, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the ids of the piece as little-endian unsigned 32-bit numbers. A document is the ids of its
    text and ``END``; null and empty texts are ``END`` alone. Every window but the last holds ``window`` ids.
    After any window a source is off its share of the tokens by less than a packet and a quantum, while its
    queue lasts. ``targets`` gives shares by source; the rest keep their natural ones. A null source is a
    source. Rows that share an id are packed one by one; an empty table gives no rows; other columns are not
    read. Queues follow the hash of the id and the row, so rows that share an id lie in many slices. A very long
    text is encoded ``words.SEGMENT`` characters at a time. Runs jobs when called.
    """
    width = words.load(path).dtype
    tokens = tokenize(docs, path, id_col, text_col, source_col)
    pieces = layout(tokens, window, packet, targets)
    # The pieces of one row only: no more than its tokens.
    listed = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    def cut(stored: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        wide = (np.frombuffer(x, width).astype("<u4") for x in stored)
        return pd.Series([[ids[a : a + n].tobytes() for a, n in zip(at, size)] for ids, at, size in zip(wide, starts, lengths)])

    ids = F.pandas_udf(cut, "array<binary>")("tokens", "pieces.start", "pieces.length")
    joined = tokens.join(listed, "row").select("id", "source", F.col("n").alias("doc_tokens"), "pieces", ids.alias("ids"))
    zipped = joined.select("id", "source", "doc_tokens", F.explode(F.arrays_zip("pieces", "ids")).alias("piece"))
    where = F.col("piece.pieces")
    return zipped.select(
        F.col("id").alias(id_col), "source", where["start"].alias("start"), where["length"].alias("length"), "doc_tokens",
        where["sequence_id"].alias("sequence_id"), where["offset"].alias("offset"), "piece.ids",
    )
