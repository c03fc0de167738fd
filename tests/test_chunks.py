import random
import re

import pytest

from cohortkit.operators import chunks as op


def cut(text, size, separators):
    out = []
    while text:
        window = text[:size]
        end = len(window)
        if len(text) > size:
            ends = [window.rfind(s) + len(s) for s in separators if s in window]
            end = ends[0] if ends else size
        out.append(text[:end])
        text = text[end:]
    return out


def brute(text, size, overlap, separators, section):
    out, at = [], 0
    for part in cut(text, section, separators):
        for piece in cut(part, size - overlap, separators):
            before = text[max(0, at - overlap) : at]
            found = re.match(f"(?s)^.*?(?:{'|'.join(map(re.escape, separators))})(.+)$", before) if separators else None
            lead = found[1] if found and at != len(before) else before
            out.append((at - len(lead), len(lead), len(lead) + len(piece), lead + piece))
            at += len(piece)
    return out


@pytest.mark.parametrize(("size", "overlap", "section", "separators"), [(30, 8, 200, op.SEPARATORS), (20, 0, 20, op.SEPARATORS), (12, 5, 1000, ("ab", " ")), (7, 3, 50, ())])
def test_against_a_plain_version(spark, size, overlap, section, separators):
    dice = random.Random(size)
    letters = ["a", "b", "é", "🙂", " ", " ", "\n", "\n\n", "\r\n", "long", "."]
    rows = [(i, "".join(dice.choice(letters) for _ in range(dice.randint(0, 300)))) for i in range(40)] + [(90, None), (91, ""), (92, "x" * 500), (93, "\n" * 100), (94, " ")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(4)
    got = {}
    for r in op.chunk_texts(docs, size, overlap, separators=separators, section=section).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.lead, r.n_chars, r.text))
    want = {i: brute(t, size, overlap, separators, section) for i, t in rows if t}
    by_place = lambda cs: sorted(cs, key=lambda c: c[0] + c[1])
    assert {i: by_place(cs) for i, cs in got.items()} == want
    for i, text in rows:
        assert "".join(c[3][c[1] :] for c in by_place(got.get(i, []))) == (text or "")
        assert all(c[2] <= size and text[c[0] : c[0] + c[2]] == c[3] for c in got.get(i, []))


def test_wrong_sizes(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for arguments in ((5, 5), (5, -1), (100, 0, "doc_id", "text", ("",)), (100, 0, "doc_id", "text", (" ",), 50)):
        with pytest.raises(ValueError):
            op.chunk_texts(docs, *arguments)
