import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortkit.llm import alignment as op
from cohortkit.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet = byte_alphabet()

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def judge(rows):
        linked, out = [], []
        for i, text in rows:
            data = (" " + text).encode() if text else b""
            a = first.encode(" " + text, add_special_tokens=False).ids if text else []
            b = second.encode(text) if text else []
            bytes_a = [bytes(alphabet[c] for c in first.id_to_token(x)) for x in a]
            bytes_b = [piece(x) for x in b]
            if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
                a, b = [], []
            ends_a, ends_b, n = {}, {}, 0
            for x, t in zip(a, bytes_a):
                n += len(t)
                ends_a[n] = x
            n = 0
            for x, t in zip(b, bytes_b):
                n += len(t)
                ends_b[n] = x
            groups, at = [], 0
            for end in sorted(ends_a.keys() & ends_b.keys()) if a else []:
                groups.append("|".join(",".join(str(x) for e, x in ends.items() if at < e <= end) for ends in (ends_a, ends_b)))
                at = end
            links = [(ends_a[e], ends_b[e]) for e in sorted(ends_a.keys() & ends_b.keys())] if a else []
            linked.append(links)
            out.append([i, len(a), len(b), len(groups), len(links), ";".join(groups)])
        counts = Counter(x for links in linked for x in links)
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(best.get(b, 0), n)
        rows = []
        for (i, n_a, n_b, n_groups, n_links, text), links in zip(out, linked):
            rows.append((i, n_a, n_b, n_groups, n_links, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha256(text.encode()).hexdigest() if links else "", text))
        return sorted(rows, key=repr), counts, best

    return judge


def corpus():
    dice = random.Random(8)
    words = ["the", "Straße", "naïve", "12345", "don't", "...", "<|endoftext|>", "<s>", "日本語", "مرحبا", "🙂🙂", "\n\n", "\t", "  ", "foo_bar", "é", "ﬁne", "\x00", "x" * 40]
    rows = [(None, "null id"), (None, "null id"), (1, None), (2, ""), (3, " "), (4, "a"), (5, "▁ mark"), (6, "y" * 3000), (7, " " * 3000 + "z"), (8, "the <unk> <0x41> thing")]
    return rows + [(10 + i, " ".join(dice.choice(words) for _ in range(dice.randint(1, 80)))) for i in range(60)]


def test_against_brute_force(spark, brute):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, radix int, chunk string").repartition(3)
    want, counts, best = brute(rows)
    got = op.align(docs, A, B, with_groups=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    pairs = {(r.a, r.b): (r.n, r.best) for r in op.pair_counts(docs, A, B).collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def test_many_runs_and_owners(spark, brute, monkeypatch):
    """Runs so small that every radix is merged by many owners, over more than one round."""
    rows = corpus()
    monkeypatch.setattr(op, "SLICE_BYTES", 60)
    monkeypatch.setattr(op, "FAN_IN", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((tuple(r) for r in op.align(docs, A, B, with_groups=True).collect()), key=repr) == brute(rows)[0]


def test_very_long_texts_are_cut_without_a_trace(monkeypatch):
    pair = op.load(A, B)
    dice = random.Random(1)
    text = " ".join(dice.choice(["the", "Straße", "don't", "12", "a.b", "naïve", "\n", "日本"]) for _ in range(3000))
    whole = pair.align(text)
    monkeypatch.setattr(op, "SEGMENT", 200)
    parts = pair.align(text)
    assert len(whole) == 1 and len(parts) > 20
    assert "".join(p[4] for p in parts) == whole[0][4]
    for k in (0, 1):
        assert [x for p in parts for x in p[k].tolist()] == whole[0][k].tolist()
    assert pair.align("x" * 5000)[0][0].tolist() == pair.slow.encode(" " + "x" * 5000, add_special_tokens=False).ids


def test_an_empty_table(spark):
    assert op.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
