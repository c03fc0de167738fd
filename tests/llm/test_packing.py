from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortkit.llm import packing, words

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", "a b", " \n\t a\x1cb ", "Don't 12٣ ²!?...", "日本 ΣΑΣ İx ſ ßé é", "x<|endoftext|>y", "ª º\xa0n\x85b　c", "w" * 3000, "A, b. C; d!"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(library, monkeypatch):
    texts = HARD + [f"word{i} and Word{i % 7}, other{i * 3}." for i in range(300)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for chunks, passing in ((10**6, 10**5), (50, 20)):
        monkeypatch.setattr(words, "CHUNKS", chunks)
        monkeypatch.setattr(words, "PASSING", passing)
        coder = words.WordTokenizer(PATH)
        for _ in range(2):
            got = [x.tolist() for i in range(0, len(texts), 40) for x in coder.encode_batch(texts[i : i + 40])]
            assert got == want


def test_chunks_with_equal_hashes_get_their_own_ids(library):
    """Polynomials modulo 2^64 with odd factors cannot tell these two strings apart."""
    one, other = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    texts = [f"x {one} y", f"{other} z", f"{one} {other}", other, one]
    coder = words.WordTokenizer(PATH)
    data = np.frombuffer((one + other).encode(), np.uint8)
    for h in coder.hashes(data, np.array([0, 1024]), np.array([1024, 2048])):
        assert h[0] == h[1]
    for _ in range(2):
        assert [x.tolist() for x in coder.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_first_hash_alone_is_shared(library, monkeypatch):
    """Different chunks under one first hash, and under both."""
    texts = [f"word{i} other{i % 9}" for i in range(200)] + ["w" * 20 + str(i) for i in range(30)]
    plain = words.WordTokenizer.hashes
    for keep in (1, 0):
        monkeypatch.setattr(words.WordTokenizer, "hashes", lambda self, *a: [h * np.uint64(k) for h, k in zip(plain(self, *a), (0, keep))])
        coder = words.WordTokenizer(PATH)
        assert [x.tolist() for x in coder.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_very_long_text(library, monkeypatch):
    text = " ".join(f"Some words, number {i}" for i in range(40_000))
    assert len(text) > words.SEGMENT
    assert words.WordTokenizer(PATH).encode_batch([text, "a", "x" * 700_000])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_third_of_the_rows_share_a_null_id(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 8)
    rows = [(None if i % 3 == 0 else i, f"text number {i} " * (i % 5), "s") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    tokens = packing.tokenize(docs, PATH).selectExpr("row", "source", "n", "id")
    parts = tokens.selectExpr("id", "pmod(xxhash64(id, row), 30) as slice").where("id IS NULL").distinct()
    assert parts.count() > 20
    pieces = packing.pack(docs, PATH, window=128, packet=32).collect()
    assert sum(p.length for p in pieces) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    ends = sorted((p.sequence_id, p.offset, p.offset + p.length) for p in pieces)
    assert all(a[2] == b[1] if a[0] == b[0] else a[2] == 128 and b[1] == 0 for a, b in zip(ends, ends[1:]))


def check(pieces, rows, library, window):
    """Every id once, gapless full windows but the last; returns tokens by (window, source)."""
    by_doc, by_window, shares = defaultdict(list), defaultdict(list), defaultdict(int)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append((p.offset, p.length))
        shares[p.sequence_id, p.source] += p.length
    for key, text in rows:
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, packing.END], 0
        for p in sorted(by_doc[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    assert sorted(by_window) == list(range(len(by_window)))
    for number, parts in by_window.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or number == len(by_window) - 1 and at < window
    return shares


@pytest.mark.parametrize("slice_rows, rounds", [(1024, 64), (3, 2)])
def test_pieces(spark, library, monkeypatch, slice_rows, rounds):
    monkeypatch.setattr(packing, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(packing, "SLICE_ROUNDS", rounds)
    monkeypatch.setattr(packing, "BLOCK", 4)
    rows = [(i, t, "s") for i, t in enumerate(HARD)] + [(20 + i, "some words here " * (i % 30), f"s{i % 3}" if i % 5 else None) for i in range(150)]
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(999, None, "s1", 1)], "doc_id long, text string, source string, row int").repartition(4)
    pieces = packing.pack(docs, PATH, window=128, packet=32).collect()
    check(pieces, [(r[0], r[1]) for r in rows] + [(999, None)], library, 128)


def test_windows_follow_the_targets(spark, library):
    rows = [(i, "the cat sat on the mat " * 20, "big") for i in range(60)] + [(100 + i, "a dog ran " * 20, "small") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, PATH, window=256, packet=16, targets={"big": 0.75, "small": 0.25}).collect()
    shares = check(pieces, [r[:2] for r in rows], library, 256)
    ahead = 0
    for number in range(20):
        ahead += shares[number, "big"] - 192
        assert abs(ahead) <= 16 + 192


def test_empty_table_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], "doc_id long, text string, source string")
    assert sum(p.length for p in packing.pack(docs, PATH).collect()) == 6
    assert packing.pack(docs.limit(0), PATH).count() == 0
