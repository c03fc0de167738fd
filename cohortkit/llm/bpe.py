"""Byte-level BPE as a streaming transducer with bounded lookahead, and the inverse for decoding."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice, repeat

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.session import ship_code

# The pattern that splits text before the merges, and the classes whose runs it never ends early.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RUNS = [regex.compile(r) for r in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]

SPLIT = regex.compile(PATTERN)
# White space before and after a space: the only place where cutting before a space changes the pieces.
UNSAFE = regex.compile(r"\s \s")
# Characters held back at the end of a block: what a match may still look at (as in 'll).
TAIL = 3
# Characters of a block, bytes encoded at once beyond the lookahead, entries of each cache.
BLOCK, STEP, CACHE = 65_536, 1_024, 300_000
# Rank of a pair that no rule joins.
NONE = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else 256 and up."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Merges:
    """Vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._build(spec["model"]["vocab"], spec["model"]["merges"], spec["added_tokens"])

    def _build(self, vocab: dict[str, int], merges: list, added: list[dict]) -> None:
        alphabet = byte_alphabet()
        self.special = {a["content"]: a["id"] for a in added}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.byte_ids = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list | tuple) else m.split(" ") for m in merges]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.rules)}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after a token beyond which no continuation can change it.

        Compare the merges of two byte strings that share a prefix, rule by rule in rank order. The part on
        which both agree shrinks only when a rule (u, v) joins its last token u with what follows in one of
        them; v then begins where the agreement ended. The next rule that moves the border again comes later
        in the list, and its v begins with the u that was lost before. So the loss is at most the largest sum
        of |u| over chains of rules of rising rank in which each u is a left part of the next v. Needs a list
        whose rules come after the rules that make their parts, which is checked.
        """
        left = dict.fromkeys(self.byte_ids)
        best: dict[int, int] = {}
        most = 0
        for u, v, joined in self.rules:
            if u not in left or v not in left:
                raise ValueError("the merge list uses a token before it is made")
            reach, part = 0, v
            while part is not None:
                reach = max(reach, best.get(part, 0))
                part = left[part]
            loss = len(self.bytes_of[u]) + reach
            best[u] = max(best.get(u, 0), loss)
            most = max(most, loss)
            left.setdefault(joined, u)
        return most

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece: the rule of least rank first, from the left."""
        ids = [self.byte_ids[b] for b in data]
        rank, rules = self.rank.get, self.rules
        ranks = list(map(rank, zip(ids, ids[1:]), repeat(NONE)))
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [rules[least][2]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NONE)
        return ids


class Transducer:
    """Bytes of one piece in, stable ids out; holds at most lookahead + STEP bytes and what one feed adds."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> Iterator[int]:
        self.held += data
        while len(self.held) >= self.merges.lookahead + STEP:
            window = self.held[: self.merges.lookahead + STEP]
            stable, taken = len(window) - self.merges.lookahead, 0
            for token in self.merges.encode_bytes(window):
                size = len(self.merges.bytes_of[token])
                if taken + size > stable:
                    break
                taken += size
                yield token
            self.held = self.held[taken:]

    def close(self) -> list[int]:
        ids, self.held = self.merges.encode_bytes(self.held), b""
        return ids


class Encoder:
    """Text to ids, block by block; pieces seen before come from bounded caches."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        if ids is None:
            data = text.encode()
            if len(data) < self.merges.lookahead + STEP:
                ids = tuple(self.merges.encode_bytes(data))
            else:
                stream = Transducer(self.merges)
                ids = (*stream.feed(data), *stream.close())
            if len(self.pieces) < CACHE and len(text) <= 64:
                self.pieces[text] = ids
        return ids

    def _plain(self, text: str) -> Iterator[int]:
        """Ids of a text without special tokens that lies in memory."""
        if UNSAFE.search(text):
            return chain.from_iterable(map(self.piece, SPLIT.findall(text)))
        first, *rest = text.split(" ")
        return chain(chain.from_iterable(map(self.piece, SPLIT.findall(first))), chain.from_iterable(map(self._chunk, rest)))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a space and what follows it up to the next one."""
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = tuple(chain.from_iterable(map(self.piece, SPLIT.findall(" " + chunk))))
            if len(self.chunks) < CACHE and len(chunk) <= 64:
                self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """All ids of a text; the strings of special tokens become their ids."""
        special = self.merges.special
        if not any(t in text for t in special):
            return list(self._plain(text))
        parts = self.merges.split_special.split(text)
        return list(chain.from_iterable((special[p],) if p in special else self._plain(p) for p in parts if p))

    def stream(self, blocks: Iterable[str]) -> Iterator[int]:
        """Ids of a text that arrives in blocks, each as soon as it is stable, in constant memory.

        A space between two other characters starts a piece of its own, so a block is encoded up to its last
        one. Without one, a match ends for good when it does not reach into the last TAIL characters; a run
        longer than a block goes to the transducer part by part. Special tokens are ordinary text here.
        """
        held, run, piece = "", None, None
        for block in chain(blocks, [None]):
            last, at = block is None, 0
            held += block or ""
            final = len(held) if last else len(held) - TAIL
            while at < final:
                if run is None and (cut := self._last_cut(held, at, final)) > at:
                    yield from self._plain(held[at:cut])
                    at = cut
                if run is not None:
                    end = match.end() if (match := run.match(held, at)) else at
                    # The last blank of a run belongs to what follows it, or stands alone.
                    stop = end - 1 if run is RUNS[-1] and at < end < len(held) else end
                    given = min(stop, final)
                    over = given == stop and (end < len(held) or last)
                    yield from piece.feed(held[at:given].encode())
                    at = given
                    if over:
                        yield from piece.close()
                        run = None
                    continue
                match = SPLIT.match(held, at)
                if last or match.end() <= final:
                    yield from self.piece(match.group())
                    at = match.end()
                    continue
                if len(held) - at <= BLOCK:
                    break
                spaced = held[at] == " " and not held[at + 1].isspace()
                run, piece = next(r for r in RUNS if r.match(held, at + spaced)), Transducer(self.merges)
                yield from piece.feed(b" " * spaced)
                at += spaced
            held = held[at:]


    @staticmethod
    def _last_cut(text: str, start: int, stop: int) -> int:
        """The last space of ``text[start:stop]`` with other characters than blanks beside it, else ``start``."""
        cut = text.rfind(" ", start + 1, stop)
        while cut > start and (text[cut - 1].isspace() or cut + 1 >= len(text) or text[cut + 1].isspace()):
            cut = text.rfind(" ", start + 1, cut)
        return max(cut, start)

    def tokens(self, text: str) -> Iterator[list[int]]:
        """Ids of a text block by block, in constant memory besides the text; special tokens become their ids."""
        parts = self.merges.split_special.split(text) if any(t in text for t in self.merges.special) else [text]
        for part in parts:
            if part in self.merges.special:
                yield [self.merges.special[part]]
                continue
            ids = self.stream(part[i : i + BLOCK] for i in range(0, len(part), BLOCK))
            while some := list(islice(ids, BLOCK)):
                yield some


class Decoder:
    """Ids in, text out: bytes of a character that is not complete yet are held back."""

    def __init__(self, merges: Merges):
        self.merges, self.state = merges, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.merges.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        return self.state.decode(b"", final=True)


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(Merges(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and ids (array of int).

    Null and empty texts have no ids; repeated rows are encoded one by one; an empty table gives no rows;
    other columns are not read. ``path`` names a vocabulary file that every worker can open.
    """
    ship_code(docs.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        coder = load(path)
        return pd.Series([coder.encode(t or "") for t in texts])

    return docs.select(F.col(id_col), F.pandas_udf(run, "array<int>")(text_col).alias("ids"))


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: ``id_col`` and text; null ids give the empty text."""
    ship_code(tokens.sparkSession)

    def run(lists: pd.Series) -> pd.Series:
        merges = load(path).merges
        out = []
        for ids in lists:
            machine = Decoder(merges)
            out.append(machine.feed([] if ids is None else ids) + machine.close())
        return pd.Series(out, dtype=object)

    return tokens.select(F.col(id_col), F.pandas_udf(run, "string")(ids_col).alias("text"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding, without moving ids out of the worker.

    ``id_col``, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8). The same rows as
    ``encode`` followed by ``decode``. A text goes through the transducer block by block and its ids are hashed
    and decoded as they come, so a very long text needs no more memory than its characters.
    """
    ship_code(docs.sparkSession)

    def run(texts: pd.Series) -> pd.DataFrame:
        coder = load(path)
        names = _names(path)
        rows = []
        for text in texts:
            machine, n = Decoder(coder.merges), 0
            listed, decoded = sha256(), sha256()
            for ids in coder.tokens(text or ""):
                listed.update(((("," if n else "") + ",".join(map(names.__getitem__, ids)))).encode())
                decoded.update(machine.feed(ids).encode())
                n += len(ids)
            decoded.update(machine.close().encode())
            rows.append((n, listed.hexdigest(), decoded.hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.pandas_udf(run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(id_col), made(text_col).alias("_digest")).select(id_col, "_digest.*")


@lru_cache(maxsize=2)
def _names(path: str) -> dict[int, str]:
    """Every id as decimal text."""
    return {i: str(i) for i in load(path).merges.bytes_of}
