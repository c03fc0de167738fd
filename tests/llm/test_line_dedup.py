import random
from collections import defaultdict

import pytest

from cohortkit.llm import line_dedup as op

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, chars, docs):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stays = [len(key(x)) < chars or len(holders[key(x)]) < docs or i == max(holders[key(x)]) for x in lines]
        out.append((i, len(lines), len(lines) - sum(stays), "\n".join(x for x, s in zip(lines, stays) if s), tuple(stays)))
    return sorted(out)


def test_against_brute_force(spark):
    dice = random.Random(4)
    pool = [dice.choice("aAÉß") * dice.randint(3, 6) + str(k) for k in range(30)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "hot line\n" * 150 + "end")]
    rows += [(10 + i, "\n".join(dice.choice(["", " ", "\t"]) + dice.choice([*pool, "Hot Line", "hot line"]) + dice.choice(["", "\r", " "]) for _ in range(dice.randint(1, 90)))) for i in range(80)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string").repartition(5)
    got = op.dedup_lines(docs, 5, 4)
    found = []
    for r in got.collect():
        words = [w & (2**64 - 1) for w in r.keep]
        stays = tuple(i // 64 >= len(words) or bool(words[i // 64] >> i % 64 & 1) for i in range(r.n_lines))
        found.append((r.doc_id, r.n_lines, r.n_dropped, r.text, stays))
    assert sorted(found) == brute(rows, 5, 4)


@pytest.mark.parametrize("copies", [4, 5])
def test_needs_five_documents(spark, copies):
    line = "This line is long enough to be looked at, it is"
    docs = spark.range(copies).selectExpr("id as doc_id", f"'{line}' as text")
    kept = {r.doc_id: r.text for r in op.dedup_lines(docs).collect()}
    assert kept == {i: line if copies < 5 or i == copies - 1 else "" for i in range(copies)}


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    line = "x" * 50
    rows = [(i, line) for i in range(5)] + [(4, line), (4, line + "\nmore"), (None, line), (None, line)]
    got = op.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in got) == [(-1, ""), (-1, ""), (0, ""), (1, ""), (2, ""), (3, ""), (4, line), (4, line), (4, line + "\nmore")]
    assert op.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
