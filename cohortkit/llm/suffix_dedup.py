"""Removal of long byte strings that also start earlier in the corpus, by two-stage suffix sorting.

Sorting every suffix of the corpus in one place does not scale, so the suffixes are dealt to owner tasks first.
Every window of ``match`` bytes names an anchor: the string of ``ANCHOR`` bytes inside it whose hash is least.
Equal windows have equal anchors, so all occurrences of a window meet at the owner of its anchor. Neighbouring
windows with one anchor travel as a single context. Equal contexts need no sorting, their first occurrence
stays; the different contexts of an anchor are sorted as suffixes, and common prefixes of neighbours tell which
windows are equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import scratch_path, ship_code, written

# Fixed value of the contract: bytes of a string that counts as repeated.
MATCH = 100
# Bytes of an anchor: long enough to be rare by itself, short beside a window.
ANCHOR = 40
# Bytes and documents of a block, window starts looked at together, bytes of contexts sorted together.
BLOCK_BYTES, BLOCK_DOCS, SEGMENT, SORT_BYTES = 2**21, 20_000, 2**22, 2**20
# Rows of an anchor from which its contexts are dealt to several owners; the share of blocks that tells so.
HOT_ROWS, SAMPLE = 4096, 8
# Window starts of one piece of a context of such an anchor.
PIECE = 8
# Factors of the hash of an anchor.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def pack_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The corpus as a bucketed table of blocks: (block, ids, sizes, data), data as one zstd run.

    Texts are moved to no other task here, and joins on ``block`` do not shuffle them later.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            made = [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(p) for p in parts]], pa.list_(pa.int32())),
                pa.array([packer.compress(b"".join(parts))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(made, ["block", "ids", "sizes", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = (text.as_py() or "").encode()
                if parts and (held + len(part) > BLOCK_BYTES or len(parts) >= BLOCK_DOCS):
                    yield block()
                    number, ids, parts, held = number + 1, [], [], 0
                ids.append(i)
                parts.append(part)
                held += len(part)
        if parts:
            yield block()

    given = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = given.mapInArrow(run, "block bigint, ids array<bigint>, sizes array<int>, data binary")
    made.write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def rank_documents(blocks: DataFrame) -> DataFrame:
    """(block, ranks): a number for every document that rises with its id, nulls first, then its place."""
    placed = blocks.select("block", F.posexplode("ids").alias("at", "id"))
    rising = [F.col("id").asc_nulls_first(), F.col("block"), F.col("at")]
    ranked = placed.repartitionByRange(*rising).sortWithinPartitions(*rising)
    numbers = written(ranked.select("block", "at", F.monotonically_increasing_id().alias("rank")), "ranks")
    in_order = F.sort_array(F.collect_list(F.struct("at", "rank")))
    return numbers.groupBy("block").agg(F.transform(in_order, lambda x: x["rank"]).alias("ranks"))


def anchors(data: np.ndarray, ends: np.ndarray, match: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first window, windows) of the runs of windows with one anchor, in parts; no window crosses an end."""
    for h, begin, n, _ in anchor_runs(data, ends, match):
        yield h, begin, n


def anchor_runs(data: np.ndarray, ends: np.ndarray, match: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``anchors``, and where the anchor of each run starts."""
    inside = match - ANCHOR + 1
    for at in range(0, max(0, len(data) - match + 1), SEGMENT):
        part = data[at : at + SEGMENT + match - 1]
        words = np.ascontiguousarray(np.ndarray((len(part) - 7,), "<u8", np.ascontiguousarray(part), 0, (1,)))
        grams = len(part) - ANCHOR + 1
        mixed = np.zeros(grams, np.uint64)
        for k in range(0, ANCHOR, 8):
            mixed = (mixed ^ words[k : k + grams]) * MIX[(k // 8) % 3]
            mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[3]
        mixed ^= mixed >> np.uint64(32)
        # The place fills the low bits: of equal hashes the first one is least.
        least = (mixed & ~np.uint64(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)
        width = 1
        while 2 * width <= inside:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < inside:
            least = np.minimum(least[: len(least) - (inside - width)], least[inside - width :])
        chosen = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        whole = np.ones(len(chosen), bool)
        for end in ends[(ends > at) & (ends < at + len(part))].tolist():
            whole[max(0, end - at - match + 1) : end - at] = False
        starts = np.flatnonzero(whole)
        if not len(starts):
            continue
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (chosen[starts[1:]] != chosen[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
        begins = np.flatnonzero(fresh)
        places = chosen[starts[begins]]
        yield mixed[places].astype(np.int64), starts[begins] + at, np.diff(np.append(begins, len(starts))), places + at


def pieces(begin: np.ndarray, n: np.ndarray, place: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, windows, first and last byte of the core) of runs cut into at most ``PIECE`` windows each.

    Cut by the distance from window to anchor, so equal windows lie in pieces with equal cores: the bytes that all
    windows at those distances share.
    """
    far, near = place - begin, place - begin - n + 1
    many = far // PIECE - near // PIECE + 1
    run = np.repeat(np.arange(len(n)), many)
    least = (far[run] // PIECE - (np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many))) * PIECE
    most = np.minimum(least + PIECE - 1, match - ANCHOR)
    first, last = np.minimum(far[run], most), np.maximum(near[run], least)
    return run, place[run] - first, first - last + 1, place[run] - least, place[run] - most + match


def _unpack(row: dict) -> tuple[bytes, np.ndarray]:
    """Bytes of a block, and where its documents begin and the last one ends."""
    sizes = np.asarray(row["sizes"], np.int64)
    return zstandard.ZstdDecompressor().decompress(row["data"], int(sizes.sum()) or 1), np.concatenate([[0], np.cumsum(sizes)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def hot_slots(blocks: DataFrame, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of anchor hashes with very many rows, and to how many owners each is dealt.

    Counted on one in ``SAMPLE`` blocks, as only the balance depends on it; at most 2^20 slots exist.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, edges = _unpack(row)
            for h, _, _ in anchors(np.frombuffer(data, np.uint8), edges[1:-1], match):
                slot, n = np.unique((h >> 44) & 0xFFFFF, return_counts=True)
                often = n >= 4
                yield pa.RecordBatch.from_arrays([pa.array(slot[often]), pa.array(n[often])], ["slot", "n"])

    sampled = blocks.where(F.pmod(F.xxhash64("block"), F.lit(SAMPLE)) == 0).select("block", "sizes", "data")
    counts = sampled.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg((F.sum("n") * SAMPLE).alias("n"))
    found = counts.where(F.col("n") > HOT_ROWS).orderBy("slot").toPandas()
    owners = np.minimum(4096, found["n"].to_numpy(np.int64) // HOT_ROWS + 1)
    return found["slot"].to_numpy(np.int64), owners


def contexts(blocks: DataFrame, ranks: DataFrame, hot: tuple[np.ndarray, np.ndarray], match: int) -> DataFrame:
    """(h, c, rank, block, s, n, salt, core): anchor, hash of the context, document, first window, windows.

    Equal contexts of a block are merged here: the first one goes on, the others are covered at once. Rows
    without ``h`` are such covers, with ``s`` as their first byte and ``n`` as their length. Contexts of a hot
    anchor go in pieces: ``salt`` deals them by content, ``core`` is the hash of what equal windows share.
    """
    slots, owners = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "rank", "block", "s", "n", "salt", "core"]
        for row in _rows(batches):
            data, edges = _unpack(row)
            view, ranked = memoryview(data), np.asarray(row["ranks"], np.int64)
            for h, begin, n, place in anchor_runs(np.frombuffer(data, np.uint8), edges[1:-1], match):
                found, is_hot = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                if len(slots):
                    slot = (h >> 44) & 0xFFFFF
                    found = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
                    is_hot = slots[found] == slot
                core = np.zeros(len(h), np.int64)
                if is_hot.any():
                    cut, cold = np.flatnonzero(is_hot), ~is_hot
                    of, a, b, x, y = pieces(begin[cut], n[cut], place[cut], match)
                    shared = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) | 1 for i, j in zip(x.tolist(), y.tolist())), np.uint64, len(of)).astype(np.int64)
                    of = cut[of]
                    h, found, is_hot = (np.concatenate([v[cold], v[of]]) for v in (h, found, is_hot))
                    begin, n, core = np.concatenate([begin[cold], a]), np.concatenate([n[cold], b]), np.concatenate([core[cold], shared])
                stop = (begin + n - 1 + match).tolist()
                c = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), stop)), np.uint64, len(h)).astype(np.int64)
                doc = np.searchsorted(edges, begin, "right") - 1
                rank, s = ranked[doc], begin - edges[doc]
                order = np.lexsort((s, rank, c, h))
                first = np.ones(len(h), bool)
                first[1:] = (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)
                go, rest = order[first], order[~first]
                salt = np.where(is_hot[go], (c[go] & 0xFFFF) % owners[found[go]] + 1 if len(slots) else 0, 0)
                block = np.full(len(h), row["block"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h[go], c[go], rank[go], block[: len(go)], s[go].astype(np.int32), n[go].astype(np.int32), salt, core[go])], names
                )
                if len(rest):
                    # Covers of one document that touch become one.
                    rest = rest[np.lexsort((s[rest], rank[rest]))]
                    r, a, b = rank[rest], s[rest], s[rest] + n[rest] - 1 + match
                    r, a, b = merge(r, a, b)
                    none = pa.nulls(len(r), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [none, none, *(pa.array(x) for x in (r, block[: len(r)], a.astype(np.int32), (b - a).astype(np.int32), r, r))], names
                    )

    given = blocks.join(ranks, "block").select("block", "sizes", "data", "ranks")
    return given.mapInArrow(run, "h bigint, c bigint, rank bigint, block bigint, s int, n int, salt bigint, core bigint")


def merge(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals sorted by group and start, those that touch or overlap as one."""
    if not len(group):
        return group, start, stop
    code = np.cumsum(np.append(0, np.diff(group) != 0)).astype(np.int64) << 32
    reach = np.maximum.accumulate(code + stop)
    fresh = np.append(True, code[1:] + start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(group) - 1)
    return group[fresh], start[fresh], reach[last] - code[last]


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` in the order of their first ``depth`` symbols; symbol 0 ends it.

    Two stages: suffixes smaller than their successors are sorted directly. The others are induced: a scan over
    the buckets of first symbols from the smallest one places, for every suffix it meets, the greater suffix
    that starts one symbol before. A run of the bucket's own symbol is placed round by round.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    nearest = change[np.minimum(np.searchsorted(change, np.arange(n)), max(0, len(change) - 1))] if len(change) else np.zeros(n, np.int64)
    smaller = (text[nearest] < text[np.minimum(nearest + 1, n - 1)]) & (nearest >= np.arange(n))
    smaller[n - 1] = True
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct].copy().view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    del keys
    by_symbol = np.searchsorted(text[direct], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def place(found: np.ndarray, symbol: int) -> np.ndarray:
        """Put the predecessors of a stretch of the order at the heads of their buckets; those of its own go back."""
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        beyond = before[first > symbol]
        kind = text[beyond]
        order = np.argsort(kind, kind="stable")
        beyond, kind = beyond[order], kind[order]
        cuts = np.flatnonzero(np.diff(kind)) + 1
        for group in np.split(beyond, cuts) if len(beyond) else []:
            heads[text[group[0]]].append(group)
        return before[first == symbol]

    for symbol in range(256):
        stretch = np.concatenate(heads[symbol]) if heads[symbol] else np.zeros(0, np.int64)
        heads[symbol] = []
        while len(stretch):
            out.append(stretch)
            stretch = place(stretch, symbol)
        own = direct[by_symbol[symbol] : by_symbol[symbol + 1]]
        if len(own):
            out.append(own)
            place(own, symbol)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether the common prefix of each suffix and the one before it in the order reaches ``depth`` symbols."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    same = np.arange(1, len(order))
    for k in [*range(0, depth - 7, 8), depth - 8]:
        same = same[words[order[same] + k] == words[order[same - 1] + k]]
    out = np.zeros(len(order), bool)
    out[same] = True
    return out


def repeated_windows(parts: list[bytes], rank: np.ndarray, start: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of some contexts: (context, offset, whether an equal one starts earlier)."""
    # No byte of UTF-8 exceeds 0xF4, so symbols can move up by one and 0 is free to end a context.
    joined = b"\xff".join(parts) + b"\xff"
    text = np.frombuffer(joined, np.uint8) + np.uint8(1)
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = sort_suffixes(text, match)
    owner = np.searchsorted(begins, order, "right") - 1
    offset = order - begins[owner]
    full = offset + match <= sizes[owner]
    order, owner, offset = order[full], owner[full], offset[full]
    kind = np.cumsum(~common_prefixes(text, order, match))
    place = start[owner] + offset
    by_place = np.lexsort((place, rank[owner], kind))
    later = np.ones(len(order), bool)
    later[by_place[np.append(True, np.diff(kind[by_place]) != 0)] if len(order) else []] = False
    return owner, offset, later


def sort_contexts(found: DataFrame, match: int) -> DataFrame:
    """(rank, block, s, n, digest): covers of windows that also start earlier in another context of the anchor.

    Contexts that share anchor and core but fill more than one sort come back window by window as well: each
    window that is first in its sort, with a digest, for the sorts to be merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rank", "block", "s", "n", "digest"]
        held: list[dict] = []
        size = 0
        cut: set[tuple] = set()

        def emit() -> Iterator[pa.RecordBatch]:
            parts = [r["part"] for r in held]
            rank, block, start = (np.array([r[k] for r in held], np.int64) for k in ("rank", "block", "s"))
            owner, offset, later = repeated_windows(parts, rank, start, match)
            by = np.lexsort((offset[later], owner[later]))
            who, at = owner[later][by], offset[later][by]
            who, a, b = merge(who, at, at + match)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank[who]), pa.array(block[who]), pa.array((start[who] + a).astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.nulls(len(who), pa.binary())],
                names,
            )
            split = np.array([(r["h"], r["core"]) in cut for r in held])
            go = ~later & split[owner]
            if go.any():
                who, at = owner[go], offset[go]
                digests = [xxhash.xxh3_128_digest(parts[i][j : j + match]) for i, j in zip(who.tolist(), at.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank[who]), pa.array(block[who]), pa.array((start[who] + at).astype(np.int32)), pa.array(np.full(len(who), match, np.int32)), pa.array(digests, pa.binary())],
                    names,
                )

        for row in (r for batch in batches for r in batch.to_pylist()):
            same = bool(held) and (held[-1]["h"], held[-1]["core"]) == (row["h"], row["core"])
            if size >= SORT_BYTES and (not same or size >= 2 * SORT_BYTES):
                if same:
                    cut.add((row["h"], row["core"]))
                yield from emit()
                held, size = [], 0
                cut = {k for k in cut if k == (row["h"], row["core"])}
            held.append(row)
            size += len(row["part"])
        if held:
            yield from emit()

    keys = ["h", "core"]
    dealt = found.select(*keys, "rank", "block", "s", "part").repartition(*keys).sortWithinPartitions(*keys, "rank", "s")
    return dealt.mapInArrow(run, "rank bigint, block bigint, s int, n int, digest binary")


def _parts(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, edges = _unpack(row)
            at = dict(zip(row["ranks"], edges.tolist()))
            rows = row["wanted"]
            for k in range(0, len(rows), 10_000):
                some = rows[k : k + 10_000]
                begins = [at[w["rank"]] + w["s"] for w in some]
                part = [data[a : a + w["n"]] for a, w in zip(begins, some)]
                columns = [pa.array([w[c] for w in some], t) for c, t in (("h", pa.int64()), ("core", pa.int64()), ("rank", pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([row["block"]] * len(some), pa.int64()), pa.array([w["s"] for w in some], pa.int32()), pa.array(part, pa.binary())],
                    ["h", "core", "rank", "block", "s", "part"],
                )

    grouped = wanted.groupBy("block").agg(F.collect_list(F.struct("h", "core", "rank", "s", "n")).alias("wanted"))
    given = blocks.join(grouped, "block").select("block", "sizes", "data", "ranks", "wanted")
    return given.mapInArrow(run, "h bigint, core bigint, rank bigint, block bigint, s int, part binary")


def _results(blocks: DataFrame, covers: DataFrame, id_col: str) -> DataFrame:
    """Every document with what its covers leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"]
        for row in _rows(batches):
            data, edges = _unpack(row)
            found = row["covers"] or []
            place = {r: i for i, r in enumerate(row["ranks"])}
            doc = np.array([place[x["rank"]] for x in found], np.int64)
            a, n = (np.array([x[k] for x in found], np.int64) for k in ("s", "n"))
            by = np.lexsort((a, doc))
            doc, a, b = merge(doc[by], a[by], (a + n)[by])
            cuts = np.searchsorted(doc, np.arange(len(edges)))
            out = []
            for i, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                lo, hi = cuts[i], cuts[i + 1]
                if lo == hi:
                    out.append((row["ids"][i], end - begin, 0, 0, [], data[begin:end]))
                    continue
                x, y = a[lo:hi].tolist(), b[lo:hi].tolist()
                left = b"".join(data[begin + p : begin + q] for p, q in zip([0, *y], [*x, end - begin]))
                out.append((row["ids"][i], end - begin, sum(y) - sum(x), hi - lo, [{"start": p, "stop": q} for p, q in zip(x, y)], left))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    grouped = covers.groupBy("block").agg(F.collect_list(F.struct("rank", "s", "n")).alias("covers"))
    given = blocks.join(grouped, "block", "left").select("block", "ids", "sizes", "data", "ranks", "covers")
    return given.mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def dedup_substrings(docs: DataFrame, match: int = MATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, n_removed, n_spans, spans, kept (the bytes that are left).

    A byte goes when a string of ``match`` bytes over it also starts earlier: in a document with a smaller id,
    or before it in the same one. Texts count as UTF-8; matches do not cross documents and are judged on the
    texts as given. A null or empty text has no bytes. Null ids come before all others. Rows that share an id
    follow the order in which they are stored, so of repeated rows the first one stays. A very long text is
    looked at ``SEGMENT`` bytes at a time, and its contexts are sorted by many tasks. An empty table gives no
    rows. Other columns are not read, so their names cannot clash.
    """
    if match < ANCHOR + 8:
        raise ValueError(f"match needs at least {ANCHOR + 8} bytes")
    ship_code(docs.sparkSession)
    blocks = pack_blocks(docs, id_col, text_col)
    ranks = rank_documents(blocks)
    placed = contexts(blocks, ranks, hot_slots(blocks, match), match).repartition("h", "salt")
    # Rows of an anchor lie together by now: both windows use the one shuffle.
    of_context, of_anchor = Window.partitionBy("h", "salt", "c").orderBy("rank", "s"), Window.partitionBy("h", "salt")
    judged = placed.select(
        "*",
        (F.row_number().over(of_context) == 1).alias("first"),
        ((F.min("c").over(of_anchor) != F.max("c").over(of_anchor)) | (F.col("salt") > 0)).alias("mixed"),
    )
    is_cover = F.col("h").isNull() | ~F.col("first")
    kept = judged.where(is_cover | F.col("mixed")).select(
        "h", "core", "rank", "block", "s", F.when(F.col("h").isNull(), F.col("n")).otherwise(F.col("n") + match - 1).alias("n"), is_cover.alias("cover")
    )
    rows = written(kept, "contexts")
    # Pieces of a hot anchor are all different by now; one whose core no other has needs no sorting.
    hot = rows.where("NOT cover AND core != 0").withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("h", "core")) - 1)
    wanted = rows.where("NOT cover AND core = 0").unionByName(hot.where("others > 0").drop("others"))
    ranked = blocks.join(ranks, "block")
    sorted_windows = written(sort_contexts(_parts(ranked, wanted), match), "windows")
    of_window = Window.partitionBy("digest").orderBy("rank", "s")
    merged = sorted_windows.where(F.col("digest").isNotNull()).withColumn("again", F.row_number().over(of_window) > 1).where("again")
    place = ["rank", "block", "s", "n"]
    covers = rows.where("cover").select(*place).unionByName(sorted_windows.where(F.col("digest").isNull()).select(*place)).unionByName(merged.select(*place))
    return _results(ranked, covers, id_col)
