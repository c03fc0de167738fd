"""Ids of a public tokenizer for whole texts; the ids of chunks seen before come from a bounded table."""

from __future__ import annotations

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

from cohortkit.session import kept

# The pattern that splits a chunk without blanks into the pieces the merges see, and the ASCII blanks.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
BLANKS = b"\t\n\x0b\x0c\r "
BLANK = regex.compile(r"[\t\n\x0b\x0c\r ]")
# Characters beyond Latin letters, which composing or lower case may change in other ways, separators that are
# no blanks, and special tokens.
OTHER = regex.compile(r"[^\x00-ɏ]|İ|[\x1c-\x1f]|<\|")
# Marks that often end a chunk; a run of them is one piece.
ENDS = ".,;:!?"
# Chunks kept for good, chunks kept until there are more of them, pieces kept.
CHUNKS, PASSING, PIECE_CACHE = 500_000, 100_000, 100_000
# Characters looked at together, which bounds the arrays.
SEGMENT = 500_000
# Odd factors of the two hashes of a chunk.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def segments(text: str) -> list[str]:
    """The text in parts of about ``SEGMENT`` characters, cut at ASCII blanks only."""
    out, at = [], 0
    while len(text) - at > SEGMENT:
        blank = BLANK.search(text, at + SEGMENT)
        if blank is None:
            break
        out.append(text[at : blank.start()])
        at = blank.end()
    return [*out, text[at:]]


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Slots:
    """Open addressing from two 64-bit hashes to entry numbers, for whole arrays at once."""

    def __init__(self, bits: int):
        self.bits, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entry of every pair of hashes, -1 where there is none."""
        out = np.full(len(first), -1, np.int32)
        rows, at = np.arange(len(first)), (first >> self.bits).astype(np.int64)
        while len(rows):
            held = self.entry[at]
            same = (held >= 0) & (self.first[at] == first[rows]) & (self.second[at] == second[rows])
            out[rows[same]] = held[same]
            go = (held >= 0) & ~same
            rows, at = rows[go], (at[go] + 1) & self.mask
        return out

    def add(self, first: np.ndarray, second: np.ndarray, entry: np.ndarray) -> None:
        """Place distinct new pairs; of those that want one free slot the first gets it, the others move on."""
        rows, at = np.arange(len(first)), (first >> self.bits).astype(np.int64)
        while len(rows):
            free = np.flatnonzero(self.entry[at] < 0)
            _, chosen = np.unique(at[free], return_index=True)
            won = free[chosen]
            self.entry[at[won]] = entry[rows[won]]
            self.first[at[won]], self.second[at[won]] = first[rows[won]], second[rows[won]]
            lost = np.ones(len(rows), bool)
            lost[won] = False
            rows, at = rows[lost], (at[lost] + 1) & self.mask


class WordTokenizer:
    """Same ids as ``Tokenizer.encode``: blanks end every piece, so a text is encoded chunk by chunk.

    Chunks are found and looked up for many texts at once, by two hashes; their bytes are compared with those of
    the entry found. New pieces go through the tokenizer's model in one
    call; each ends with a token of a word's end. A chunk with other characters goes through the tokenizer
    whole. Ids are kept and returned as little-endian numbers, of two bytes if the vocabulary allows it, else
    four.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 2**16 else "<u4")
        # For pieces that are already in their final form: the same model behind blanks alone.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.blank = np.zeros(256, bool)
        self.blank[list(BLANKS)] = True
        self.pieces: dict[str, list[int]] = {}
        self.kept, self.passing = Slots(CHUNKS.bit_length() + 1), Slots(PASSING.bit_length() + 2)
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        # The bytes of every entry, for the comparison on a hit: length, first and last eight, all of a longer one.
        self.length, self.head, self.tail = np.zeros(1024, np.int64), np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.long: dict[int, bytes] = {}
        self.ids = np.zeros(4096, self.dtype)
        self.entries = self.used = 0
        # What the table for good held when it was full.
        self.full: tuple[int, int] | None = None
        self.power = [(_powers(f, 1), _powers(pow(f, -1, 2**64), 1)) for f in FACTORS]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn_pieces(self, pieces: list[str]) -> None:
        ids = np.asarray(self.model.encode(" ".join(pieces), add_special_tokens=False).ids, self.dtype)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            raise ValueError("the tokenizer does not end every piece with a word's end")
        values, at = ids.tolist(), 0
        for piece, stop in zip(pieces, stops.tolist()):
            self.pieces[piece] = values[at:stop]
            at = stop

    @staticmethod
    def split_chunk(chunk: str) -> tuple[str, ...] | list[str] | None:
        """The pieces of a chunk without blanks; None if it has to go through the tokenizer whole."""
        if chunk.isalpha() and chunk.isascii():
            return (chunk.lower(),)
        if OTHER.search(chunk):
            return None
        word = chunk.rstrip(ENDS)
        if word.isalpha():
            return (word.lower(), chunk[len(word) :]) if len(word) < len(chunk) else (word.lower(),)
        return PIECES.findall(chunk.lower())

    def learn(self, chunks: list[str], first: np.ndarray, second: np.ndarray, place: bool = True) -> np.ndarray:
        """Add new chunks with their hashes, and return their entries; without ``place`` they cannot be looked up."""
        split = [self.split_chunk(c) for c in chunks]
        unknown = list({p for s in split if s for p in s}.difference(self.pieces))
        if unknown:
            self.learn_pieces(unknown)
        pieces = self.pieces
        lists = [self.whole(c) if s is None else pieces[s[0]] if len(s) == 1 else [i for p in s for i in pieces[p]] for c, s in zip(chunks, split)]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter((i for x in lists for i in x), self.dtype, int(sizes.sum()))
        if len(self.pieces) > PIECE_CACHE:
            for piece in unknown:
                del self.pieces[piece]
        entry = np.arange(self.entries, self.entries + len(lists), dtype=np.int32)
        while len(self.start) < self.entries + len(lists):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.size[entry] = sizes
        self.start[entry] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        while len(self.length) < self.entries + len(lists):
            self.length, self.head, self.tail = (np.resize(x, 2 * len(x)) for x in (self.length, self.head, self.tail))
        for e, chunk in zip(entry.tolist(), chunks):
            data = chunk.encode()
            self.length[e] = len(data)
            self.head[e], self.tail[e] = int.from_bytes(data[:8], "little"), int.from_bytes(data[-8:], "little")
            if len(data) > 16:
                self.long[e] = data
        self.entries, self.used = self.entries + len(lists), self.used + len(flat)
        if place:
            (self.kept if self.full is None else self.passing).add(first, second, entry)
            if self.full is None and self.entries >= CHUNKS:
                self.full = self.entries, self.used
        return entry

    def differs(self, entry: np.ndarray, joined: bytes, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Whether the bytes of chunks are others than those of their entries; true for entry -1."""
        size = stops - starts
        eight = np.ndarray((len(data) + 1,), "<u8", joined + bytes(8), 0, (1,))
        mask = ~np.uint64(0) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
        head = eight[starts] & mask
        tail = np.where(size > 8, eight[np.maximum(stops - 8, 0)], head)
        out = (entry < 0) | (self.length[entry] != size) | (self.head[entry] != head) | (self.tail[entry] != tail)
        for i in np.flatnonzero(~out & (size > 16)).tolist():
            out[i] = self.long[entry[i]] != joined[starts[i] : stops[i]]
        return out

    def hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
        """Two hashes of every chunk, from sums over prefixes of the data."""
        out = []
        values = data.astype(np.uint64) + np.uint64(1)
        for k, factor in enumerate(FACTORS):
            if len(self.power[k][0]) < len(data):
                self.power[k] = _powers(factor, 2 * len(data)), _powers(pow(factor, -1, 2**64), 2 * len(data))
            up, down = self.power[k]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values * up[: len(data)], out=sums[1:])
            mixed = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(FACTORS[1 - k])
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(mixed ^ (mixed >> np.uint64(29)))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; null as empty. Works on about ``SEGMENT`` characters at a time."""
        owner: list[int] = []
        parts: list[str] = []
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held = 0
        for i, text in enumerate(texts):
            for segment in segments(text or ""):
                owner.append(i)
                parts.append(segment)
                held += len(segment)
                if held >= SEGMENT:
                    for j, ids in zip(owner, self._encode(parts)):
                        out[j].append(ids)
                    owner, parts, held = [], [], 0
        for j, ids in zip(owner, self._encode(parts)):
            out[j].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, self.dtype), *x]) for x in out]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.full is not None and self.entries - self.full[0] > PASSING:
            self.long = {e: x for e, x in self.long.items() if e < self.full[0]}
            self.entries, self.used = self.full
            self.passing = Slots(PASSING.bit_length() + 2)
        parts = [t.encode() for t in texts]
        joined = b" ".join(parts)
        data = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        solid = ~self.blank[data]
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first, second = self.hashes(data, starts, stops)
        entry = self.kept.find(first, second)
        missing = np.flatnonzero(entry < 0)
        if len(missing) and self.full is not None:
            entry[missing] = self.passing.find(first[missing], second[missing])
            missing = missing[entry[missing] < 0]
        if len(missing):
            _, once = np.unique(first[missing], return_index=True)
            new = missing[once]
            chunks = [joined[a:b].decode() for a, b in zip(starts[new].tolist(), stops[new].tolist())]
            slots = self.kept if self.full is None else self.passing
            self.learn(chunks, first[new], second[new])
            entry[missing] = slots.find(first[missing], second[missing])
        # Hashes only find an entry; where its bytes are others, the chunk gets ids of its own.
        wrong = np.flatnonzero(self.differs(entry, joined, data, starts, stops))
        if len(wrong):
            chunks = [joined[a:b].decode() for a, b in zip(starts[wrong].tolist(), stops[wrong].tolist())]
            entry[wrong] = self.learn(chunks, first[wrong], second[wrong], place=False)
        sizes = self.size[entry].astype(np.int64)
        done = np.cumsum(sizes)
        flat = np.repeat(self.start[entry] - (done - sizes), sizes) + np.arange(int(done[-1]) if len(done) else 0)
        ids = self.ids[flat]
        cuts = np.concatenate([[0], done])[np.searchsorted(starts, begins)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def load(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and file, until the worker has to give it back."""
    return kept(("words", path), lambda: WordTokenizer(path))
