import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortkit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "  ", "a  b", "a \n b", "x<|endoftext|>y  z", "   a", "a\x1c b\x1d\x1e c", "I'll don't 'S 12٣4 ²", "日本語 テスト 😀😀 é", "a" * 5000, " " * 3000 + "x", "ab" * 3000 + "\n" * 400]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def coder():
    return bpe.Encoder(bpe.load(PATH).merges)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def noise(dice, n):
    return "".join(dice.choice(" \n\t \x1cab'sreltvmdXé1²٣.,-_日ğ́😀 \x85") for _ in range(n))


def test_same_ids_as_the_library(library, coder):
    dice = random.Random(1)
    for text in HARD + [noise(dice, dice.randint(0, 30)) for _ in range(1500)]:
        assert coder.encode(text) == ids(library, text), text
        assert "".join([(d := bpe.Decoder(coder.merges)).feed(coder.encode(text)), d.close()]) == text


def test_stream_in_blocks(library, coder, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 40)
    monkeypatch.setattr(bpe, "STEP", 20)
    dice = random.Random(2)
    texts = [t for t in HARD if "<|" not in t] + [noise(dice, 40) for _ in range(300)]
    texts += [dice.choice(["", "x ", "\n"]) + dice.choice([" ", "'", " 7", "\n", "ll", "ab"]) * dice.randint(100, 500) + dice.choice(["", " ", "b", "  b", "'ll"]) for _ in range(80)]
    for text in texts:
        for size in (3, 50, 10_000):
            assert list(coder.stream(text[i : i + size] for i in range(0, len(text), size))) == ids(library, text), (text, size)


def test_tokens_block_by_block(library, coder, monkeypatch):
    """Special tokens at and across the borders of blocks, and texts without a place to cut."""
    monkeypatch.setattr(bpe, "BLOCK", 40)
    dice = random.Random(4)
    texts = HARD + ["y" * n + "<|endoftext|>" + " z" * n for n in (0, 1, 27, 28, 39, 40, 41)] + ["<|endoftext|>" * 9, "<|endoftext|", "a <|endoftext|> b"]
    texts += [noise(dice, 60) + dice.choice(["<|endoftext|>", "x y ", ""]) + noise(dice, 60) for _ in range(300)]
    for text in texts:
        parts = list(coder.tokens(text))
        assert [i for p in parts for i in p] == ids(library, text), text
        assert all(len(p) <= 40 for p in parts)


def test_transducer_holds_little(library, coder):
    stream, dice, given, held = bpe.Transducer(coder.merges), random.Random(3), [], 0
    text = "".join(dice.choice("abcde") for _ in range(20_000))
    for i in range(0, len(text), 100):
        given += stream.feed(text[i : i + 100].encode())
        held = max(held, len(stream.held))
    assert given + stream.close() == ids(library, text) and held < coder.merges.lookahead + bpe.STEP + 100


def test_lookahead_is_sufficient(coder):
    """Tokens that end before the lookahead are the same for any continuation."""
    dice, merges = random.Random(5), coder.merges
    for _ in range(100):
        shared = bytes(dice.choice(b"aetinos") for _ in range(merges.lookahead + 40))
        cut = 40
        firsts = set()
        for _ in range(3):
            taken, out = 0, []
            for token in merges.encode_bytes(shared + bytes(dice.choice(b"aetinos") for _ in range(20))):
                taken += len(merges.bytes_of[token])
                if taken > cut:
                    break
                out.append(token)
            firsts.add(tuple(out))
        assert len(firsts) == 1


def test_decoder_holds_incomplete_characters(coder, library):
    parts = coder.encode("é😀")
    machine = bpe.Decoder(coder.merges)
    assert "".join(machine.feed([i]) for i in parts) + machine.close() == "é😀"
    broken = coder.merges.byte_ids[0xC3], coder.merges.byte_ids[0x41], coder.merges.byte_ids[0xF0]
    machine = bpe.Decoder(coder.merges)
    assert machine.feed(broken) + machine.close() == library.decode(list(broken), skip_special_tokens=False)


def test_frames(spark, library):
    rows = [(1, "Hello you"), (1, "Hello you"), (2, None), (None, ""), (3, "a" * 50_000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, ids string")
    tokens = bpe.encode(docs, PATH)
    got = {r.doc_id: r.ids for r in tokens.collect()}
    assert got[1] == ids(library, "Hello you") and got[2] == [] and got[3] == ids(library, "a" * 50_000)
    assert {r.doc_id: r.text for r in bpe.decode(tokens, PATH).collect()} == {1: "Hello you", 2: "", None: "", 3: "a" * 50_000}
    assert bpe.round_trip(docs, PATH).count() == 5 and bpe.round_trip(docs.limit(0), PATH).count() == 0
