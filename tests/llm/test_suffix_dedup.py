import random

import numpy as np
import pytest

from cohortkit.llm import suffix_dedup as op


def brute(rows, match):
    """Rows in the order of their documents: id and what is left."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - match + 1):
            window = data[s : s + match]
            if window in seen:
                gone[s : s + match] = b"\x01" * match
            seen.add(window)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def result(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()]


@pytest.mark.parametrize("depth", [3, 8, 40])
def test_two_stages_sort_suffixes(depth):
    dice = np.random.default_rng(depth)
    for text in (dice.integers(1, 3, 300), dice.integers(1, 200, 300), np.repeat([5, 4, 5, 6, 6], 60), np.ones(50), np.array([])):
        text = np.append(text, 0).astype(np.uint8)
        order = op.sort_suffixes(text, depth)
        keys = [bytes(text[i : i + depth]).rstrip(b"\0") for i in order]
        assert sorted(order) == list(range(len(text))) and keys == sorted(keys)


def test_against_brute_force(spark, monkeypatch):
    dice = random.Random(2)
    letters = "abcdefgh é\n\0"
    word = lambda n: "".join(dice.choice(letters) for _ in range(n))
    passages = [word(dice.randint(60, 400)) for _ in range(6)] + ["ab" * 90, "x" * 150, "long line " * 30]
    rows = [(None, passages[0] + "end"), (0, None), (1, ""), (2, "y" * 5000), (3, word(59)), (4, passages[1])]
    for i in range(5, 60):
        parts = [dice.choice(passages)[dice.randint(0, 40) :] if dice.random() < 0.6 else word(dice.randint(5, 200)) for _ in range(dice.randint(1, 8))]
        rows.append((i, "".join(parts)))
    rows += [(i + 100, rows[i][1]) for i in (7, 8, 9)]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, rank int, block string").repartition(4)
    want = sorted(brute(rows, 60), key=repr)
    assert sorted(result(op.dedup_substrings(docs, 60)), key=repr) == want
    # Anchors dealt to several owners.
    monkeypatch.setattr(op, "HOT_ROWS", 3)
    assert sorted(result(op.dedup_substrings(docs, 60)), key=repr) == want


def test_segments_and_cut_sorts():
    dice = random.Random(5)
    text = "".join(dice.choice("abc ") for _ in range(4000)) * 2
    data = np.frombuffer(text.encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*op.anchors(data, np.array([]), 100))]
    runs = {(int(s + k), int(h)) for h, s, n in zip(*whole) for k in range(n)}
    old, op.SEGMENT = op.SEGMENT, 700
    try:
        parts = [np.concatenate(x) for x in zip(*op.anchors(data, np.array([]), 100))]
    finally:
        op.SEGMENT = old
    assert {(int(s + k), int(h)) for h, s, n in zip(*parts) for k in range(n)} == runs and len(runs) == len(text) - 99


def test_repeated_rows_and_an_empty_table(spark):
    text = "x1y2" * 50 + "some other words that do not repeat at all in here, not even once, as far as one can see it is so!!"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, "short"), (2, "short")]
    got = sorted(((r.doc_id, r.n_removed) for r in op.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    first = brute([(None, text)], 100)[0][2]
    assert got == sorted([(1, len(text)), (1, len(text)), (None, first), (None, len(text)), (2, 0), (2, 0)], key=repr)
    assert op.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        op.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 30)


def test_windows_of_a_frequent_anchor_are_not_sent_one_by_one(spark, monkeypatch):
    dice = random.Random(9)
    word = lambda n: "".join(dice.choice("abcdefghij ") for _ in range(n))
    line, twin = word(70), word(300)
    rows = [(i, word(dice.randint(60, 150)) + line + word(dice.randint(60, 150))) for i in range(400)]
    rows += [(i, twin[dice.randint(0, 90) : 150] + line + twin[150 : dice.randint(210, 300)]) for i in range(400, 440)]
    monkeypatch.setattr(op, "HOT_ROWS", 3)
    monkeypatch.setattr(op, "SAMPLE", 1)
    made, written = {}, op.written
    monkeypatch.setattr(op, "written", lambda df, name="scratch": made.setdefault(name, written(df, name)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(result(op.dedup_substrings(docs))) == brute(rows, 100)
    # The pieces that have company are sorted in one place; none of their windows needs a digest.
    assert made["windows"].where("digest IS NOT NULL").count() == 0
    assert made["contexts"].where("core != 0").count() > 400


def test_a_group_beyond_one_sort_is_still_merged(spark, monkeypatch):
    dice = random.Random(11)
    word = lambda n: "".join(dice.choice("abcdefghij ") for _ in range(n))
    line, tails = word(95), [word(60) for _ in range(30)]
    rows = [(i, line + dice.choice(tails)[: dice.randint(4, 60)] + word(20)) for i in range(200)]
    monkeypatch.setattr(op, "SORT_BYTES", 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 100)
    for hot in (3, 4096):
        monkeypatch.setattr(op, "HOT_ROWS", hot)
        monkeypatch.setattr(op, "SAMPLE", 1)
        assert sorted(result(op.dedup_substrings(docs))) == want
