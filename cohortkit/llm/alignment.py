"""Alignment of two tokenizers by external spill counting.

Both tokenizers cut the same bytes. Wherever a token of each ends at the same place, the two tokens are linked,
and the ids of a pair count once per link over the whole corpus. Tasks spill their (pair, document) records as
sorted zstd runs, one per radix of the second tokenizer's id. Owners of a radix merge the runs by a heap, one
id of that side at a time, so counts and their maximum come out together; a second pass over the runs streams
what each link contributes back to its document.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortkit.llm.bpe import PATTERN, byte_alphabet
from cohortkit.session import ship_code, written

# Radixes of the second tokenizer's ids, bytes of runs that one owner merges, merged runs an owner takes next.
RADIXES, SLICE_BYTES, FAN_IN = 64, 2**25, 64
# Texts and bytes of a chunk, characters encoded at once.
CHUNK_DOCS, CHUNK_BYTES, SEGMENT = 4096, 2**23, 2**18
# Longest run without a blank, or of blanks, that the fast encoder is given.
LONG = 1000
# A space between two letters or digits: neither tokenizer has a token across it.
CUT = re.compile(r"[^\W_] (?=[^\W_])")
# Characters beyond these go through the reference encoder, as tables of characters differ between versions.
OTHER = re.compile(r"[^\x00-ɏ]")
BLANKS = re.compile(r"\s{%d}" % LONG)
# The mark of a space in pieces, and pieces that stand for one byte.
SPACE, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")


class Pair:
    """The two tokenizers, and the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        self.slow = Tokenizer.from_file(path_a)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [spec["model"]["vocab"][m.replace(" ", "") if isinstance(m, str) else m[0] + m[1]] for m in spec["model"]["merges"]]
        # Where ids rise with the merges, ids are ranks and the fast encoder gives the same tokens.
        self.fast = tiktoken.Encoding("pair", pat_str=PATTERN, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={}) if made == sorted(made) else None
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.can_cut = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        bytes_a = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes_a, self.bytes_b = (np.array([*x, None], object)[:-1] for x in (bytes_a, bytes_b))
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (bytes_a, bytes_b))
        # Decimal ids with what follows them: another id of the side, the other side, the next group.
        self.names = np.array([f"{i}{mark}" for mark in ",|" for i in range(len(bytes_a))] + [f"{i}{mark}" for mark in ",;" for i in range(len(bytes_b))], object)

    def first(self, text: str) -> np.ndarray:
        plain = self.fast and not OTHER.search(text) and not BLANKS.search(text) and max(map(len, text.split()), default=0) < LONG
        return np.asarray(self.fast.encode_ordinary(text) if plain else self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def segments(self, text: str) -> list[str]:
        """The text in parts; the space of a cut goes, as every part is encoded behind one."""
        out, at = [], 0
        while self.can_cut and len(text) - at > SEGMENT:
            cut = CUT.search(text, at + SEGMENT)
            if cut is None:
                break
            out.append(text[at : cut.start() + 1])
            at = cut.end()
        return [*out, text[at:]]

    def align(self, text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]] | None:
        """(ids of each side, place of the linked ids in both, groups) of every segment; None if bytes differ."""
        out = []
        for segment in self.segments(text) if text else ():
            spaced = " " + segment
            data = spaced.encode()
            a, b = self.first(spaced), np.asarray(self.second.encode(segment), np.int64)
            if b"".join(self.bytes_a[a]) != data or b"".join(self.bytes_b[b]) != data:
                return None
            out.append((a, b, *self.link(a, b)))
        return out or None

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        # No token is empty, so at most one token of a side ends at a place.
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.minimum(np.searchsorted(ends_a, ends_b), len(a) - 1)
        last_b = np.flatnonzero(ends_a[at] == ends_b)
        last_a = at[last_b]
        in_a, in_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        in_a[last_a], in_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        # A group's ids of the one side, then those of the other.
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = a + in_a * len(self.bytes_a)
        names[np.arange(len(b)) + (last_a + 1)[group_b]] = b + 2 * len(self.bytes_a) + in_b * len(self.bytes_b)
        return last_a, last_b, "".join(self.names[names])


@lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Pair:
    """One pair per Python worker."""
    return Pair(path_a, path_b)


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as one zstd run; each array begins with its length and the width of its numbers."""
    parts = []
    for x in arrays:
        small = x.astype("<u4") if not len(x) or x.max() < 2**32 else x.astype("<u8")
        parts.append(np.array([len(small), small.itemsize], "<u8").tobytes() + small.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(run: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompressobj().decompress(run), [], 0
    while at < len(data):
        n, width = np.frombuffer(data, "<u8", 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{width}", n, at + 16).astype(np.int64))
        at += 16 + n * width
    return out


SPILL = "chunk bigint, radix int, bytes bigint, data binary, ids array<bigint>, counts array<array<bigint>>, digests array<string>, groups array<string>"


def spill(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """A written table of runs (radix 0 and up) and of chunks of documents (radix -1).

    A run holds the records of one chunk and radix, sorted by pair and document: distinct pairs with the
    second id leading, documents per pair, place of the documents in the chunk, links per record.
    """
    ship_code(docs.sparkSession)
    schema = pa.schema(
        [("chunk", pa.int64()), ("radix", pa.int32()), ("bytes", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))]
        + [("counts", pa.list_(pa.list_(pa.int64()))), ("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = load(path_a, path_b)
        width = len(pair.bytes_a)
        chunk = TaskContext.get().partitionId() << 32
        ids, counts, digests, groups, links, owners = [], [], [], [], [], []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            b, a = (np.concatenate([x[k] for x in links] or [np.zeros(0, np.int64)]) for k in (1, 0))
            doc = np.repeat(np.array(owners, np.int64), [len(x[0]) for x in links])
            # Sorted by radix, then by the second id, the first one and the document.
            radix_width = -(-len(pair.bytes_b) // RADIXES)
            code = ((b % RADIXES) * radix_width + b // RADIXES) * width + a
            keys, n = np.unique(code * CHUNK_DOCS + doc, return_counts=True)
            code, doc = keys // CHUNK_DOCS, keys % CHUNK_DOCS
            edges = np.searchsorted(code, np.arange(RADIXES + 1) * radix_width * width)
            rows = [dict(chunk=chunk, radix=-1, bytes=0, ids=ids, counts=counts, digests=digests, groups=groups if with_groups else None)]
            for r in range(RADIXES):
                lo, hi = edges[r], edges[r + 1]
                if lo < hi:
                    begins = np.flatnonzero(np.append(True, np.diff(code[lo:hi]) != 0))
                    pairs = code[lo:hi][begins] - r * radix_width * width
                    data = _pack(pairs, np.diff(np.append(begins, hi - lo)), doc[lo:hi], n[lo:hi])
                    rows.append(dict(chunk=chunk, radix=r, bytes=len(data), data=data))
            yield pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = pair.align(text)
                n_a = n_b = n_links = 0
                hashed, whole = sha256(), []
                for k, (a, b, last_a, last_b, names) in enumerate(found or ()):
                    if k + 1 == len(found):
                        names = names[:-1]
                    hashed.update(names.encode())
                    if with_groups:
                        whole.append(names)
                    links.append((a[last_a], b[last_b]))
                    owners.append(len(ids))
                    n_a, n_b, n_links = n_a + len(a), n_b + len(b), n_links + len(last_a)
                ids.append(i)
                counts.append([n_a, n_b, n_links])
                digests.append(hashed.hexdigest() if found else "")
                groups.append("".join(whole))
                held += len(text or "")
                if held >= CHUNK_BYTES or len(ids) == CHUNK_DOCS:
                    yield from close()
                    chunk, held = chunk + 1, 0
                    ids, counts, digests, groups, links, owners = [], [], [], [], [], []
        if ids:
            yield from close()

    given = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return written(given.mapInArrow(run, SPILL), "runs")


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs with their counts from sorted runs of such, by a heap, one id of the leading side after the other."""
    sides = [codes // width for codes, _ in runs]
    begins = [np.flatnonzero(np.append(True, np.diff(s) != 0)) if len(s) else np.zeros(0, np.int64) for s in sides]
    heads = [s[b].tolist() for s, b in zip(sides, begins)]
    edges = [[*b.tolist(), len(s)] for s, b in zip(sides, begins)]
    heap = [(h[0], r, 0) for r, h in enumerate(heads) if h]
    heapq.heapify(heap)
    while heap:
        side, codes, counts = heap[0][0], [], []
        while heap and heap[0][0] == side:
            _, r, k = heap[0]
            lo, hi = edges[r][k], edges[r][k + 1]
            codes.append(runs[r][0][lo:hi])
            counts.append(runs[r][1][lo:hi])
            if k + 1 < len(heads[r]):
                heapq.heapreplace(heap, (heads[r][k + 1], r, k + 1))
            else:
                heapq.heappop(heap)
        if len(codes) == 1:
            yield codes[0], counts[0]
            continue
        code, n = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.append(True, np.diff(code) != 0))
        yield code[first], np.add.reduceat(n, first)


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that share their keys, from rows sorted by them."""
    key, held = None, []
    for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
        now = tuple(row[k] for k in keys)
        if held and now != key:
            yield key, held
            held = []
        key = now
        held.append(row)
    if held:
        yield key, held


def count_pairs(runs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(slices, totals): owners per radix, and per radix its pairs, their counts, and whether a count is the highest of its second id.

    An owner merges runs of about ``SLICE_BYTES``; what it counted is a run again, and ``FAN_IN`` of those are
    merged until there is one for a radix. So a frequent id is never counted by one task alone.
    """

    def merger(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (radix, owner), rows in _grouped(batches, ("radix", "owner")):
                given = []
                for row in rows:
                    parts = _unpack(row["data"])
                    if len(parts) == 4:
                        codes, docs, _, links = parts
                        given.append((codes, np.add.reduceat(links, np.cumsum(docs) - docs)))
                    else:
                        given.append((parts[0], parts[1]))
                found = list(merge_runs(given, width))
                columns = [np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])]
                if last:
                    columns.append(np.concatenate([n == n.max() for _, n in found]).astype(np.int64))
                data = _pack(*columns)
                yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([owner], pa.int64()), pa.array([data], pa.binary())], ["radix", "owner", "data"])

        return run

    spark = runs.sparkSession
    sizes = runs.groupBy("radix").agg(F.sum("bytes").alias("bytes")).collect()
    owners = {r.radix: -(-r.bytes // SLICE_BYTES) for r in sizes}
    slices = spark.createDataFrame(sorted(owners.items()), "radix int, owners bigint")
    given = runs.join(F.broadcast(slices), "radix").select("radix", F.pmod(F.xxhash64("chunk"), F.col("owners")).alias("owner"), "data")
    while True:
        most = max(owners.values(), default=1)
        dealt = given.repartition("radix", "owner").sortWithinPartitions("radix", "owner")
        merged = written(dealt.mapInArrow(merger(most == 1), "radix int, owner bigint, data binary"), "counts")
        if most == 1:
            return slices, merged.select("radix", "data")
        owners = {r: -(-n // FAN_IN) for r, n in owners.items()}
        given = merged.withColumn("owner", F.floor(F.col("owner") / FAN_IN))


def contributions(runs: DataFrame, slices: DataFrame, totals: DataFrame) -> DataFrame:
    """(chunk, data): for the documents of a chunk, highest links and sum of counts over the links of one radix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, []
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            if held != row["radix"]:
                held, total = row["radix"], _unpack(row["total"])
            codes, docs, doc, links = _unpack(row["data"])
            at = np.repeat(np.searchsorted(total[0], codes), docs)
            best, count = np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
            np.add.at(best, doc, links * total[2][at])
            np.add.at(count, doc, links * total[1][at])
            n = int(doc.max()) + 1
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([_pack(best[:n], count[:n])], pa.binary())], ["chunk", "data"])

    owner = F.pmod(F.xxhash64("chunk"), F.col("owners"))
    dealt = runs.join(F.broadcast(slices), "radix").select("radix", owner.alias("owner"), "chunk", "data")
    spread = totals.join(F.broadcast(slices), "radix").select("radix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("owners") - 1)).alias("owner"), F.col("data").alias("total"))
    return dealt.join(spread, ["radix", "owner"]).mapInArrow(run, "chunk bigint, data binary")


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` names a byte-level BPE file, ``path_b`` a sentencepiece model; A encodes the text behind a space,
    B the text. Places where tokens of both end cut the tokens into groups, and the two tokens that end there are
    a link. n_best counts the links whose pair is the most frequent one of its B id, ties included; count_sum
    adds up the counts of the pairs of all links. groups_sha256 is of the groups as ``a1,a2|b1;a3|b2,b3``, which
    ``with_groups`` returns as well. A null or empty text, or one whose tokens do not give its bytes back, has no
    tokens: zeros, and empty text. A very long text is encoded ``SEGMENT`` characters at a time, cut at a space
    between letters or digits, where neither side has a token across it. Each row is a document, also if ids
    repeat or are null; ties and repeated rows need no order. An empty table gives no rows. Other columns are
    not read, so their names cannot clash.
    """
    spilled = spill(docs, path_a, path_b, id_col, text_col, with_groups)
    runs = spilled.where("radix >= 0")
    width = len(load(path_a, path_b).bytes_a)
    slices, totals = count_pairs(runs, width)
    back = contributions(runs, slices, totals).groupBy("chunk").agg(F.collect_list("data").alias("parts"))
    chunks = spilled.where("radix < 0").select("chunk", "ids", "counts", "digests", "groups")
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    types = ["bigint"] * 7 + ["string"] * (len(names) - 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            n = len(row["ids"])
            best, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for part in row["parts"] or ():
                b, c = _unpack(part)
                best[: len(b)] += b
                count[: len(c)] += c
            n_a, n_b, links = np.array(row["counts"], np.int64).reshape(-1, 3).T
            columns = [pa.array(row["ids"], pa.int64()), *map(pa.array, (n_a, n_b, links, links, best, count)), pa.array(row["digests"], pa.string())]
            if with_groups:
                columns.append(pa.array(row["groups"], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return chunks.join(back, "chunk", "left").mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip(names, types)))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment itself: (a, b, n, best) for every linked pair of ids of the corpus; see ``align``."""
    pair = load(path_a, path_b)
    width, radix_width = len(pair.bytes_a), -(-len(pair.bytes_b) // RADIXES)
    _, totals = count_pairs(spill(docs, path_a, path_b, id_col, text_col, False).where("radix >= 0"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            code, n, best = _unpack(row["data"])
            b = code // width * RADIXES + row["radix"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code % width, b % (radix_width * RADIXES), n, best == 1)], ["a", "b", "n", "best"])

    return totals.mapInArrow(run, "a bigint, b bigint, n bigint, best boolean")
