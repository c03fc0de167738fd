import hashlib
import re
from collections import defaultdict

import pytest

from cohortkit.llm import exact_dedup as op


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(key)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [(9, "a b"), (3, "a\t\n b"), (5, "a  b "), (4, ""), (1, None), (None, "a b"), (7, "x"), (7, "x"), (8, "é" * 5000), (2, "é" * 5000), (None, "lone"), (11, "\x0b")]


@pytest.mark.parametrize("bits", [2, 60])
@pytest.mark.parametrize("bucket_keys", [1, 100])
def test_against_brute_force(spark, bits, bucket_keys):
    """Two bits put several texts on one hash, so chains are compared as bytes."""
    rows = ROWS + [(100 + i, f"t{i % 17}") for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, keep_id int, hash string").repartition(3)
    got = op.exact_dedup(docs, bucket_keys=bucket_keys, hash_bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_one_text_holds_most_rows(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then string(id) else 'copy' end as text")
    got = op.exact_dedup(docs)
    assert got.where("kept").count() == 1001 and got.where("text_sha256 is null").count() == 0
    assert {r.group_size for r in got.where("doc_id % 3 = 1").collect()} == {2000}


def test_empty_table(spark):
    got = op.exact_dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and got.count() == 0
