from collections import defaultdict

from cohortkit.llm import sharding


def shards(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard_bits, r.shard_prefix, r.shard_part].append(r.n_bytes)
    return out


def test_only_oversized_buckets_split(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('é', int(id % 50)) as text", "1 as weight")
    rows = sharding.assign_shards(docs, 2000).collect()
    found = shards(rows)
    assert len(rows) == 500 and max(map(sum, found.values())) <= 2000
    halves = defaultdict(int)
    for (bits, prefix, _), sizes in found.items():
        halves[bits - 1, prefix >> 1] += sum(sizes)
    # Siblings that could have stayed together did not split.
    assert all(halves[b, p] > 2000 for b, p in halves if (b + 1, 2 * p, 0) in found and (b + 1, 2 * p + 1, 0) in found)


def test_rows_that_share_an_id_and_large_rows(spark):
    rows = [(1, "a" * 30)] * 40 + [(None, "b" * 30)] * 20 + [(2, "c" * 500), (3, None), (4, "")]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()
    assert len(found) == len(rows)
    for sizes in shards(found).values():
        assert sum(sizes) <= 100 or sizes == [500]


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {(r.shard_bits, r.shard_prefix, r.shard_part) for r in sharding.assign_shards(docs).collect()} == {(0, 0, 0)}
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('x', 10) as text")
    sharding.write_shards(docs, str(tmp_path / "s"), 100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 60 and back.groupBy("_shard").sum("doc_id").count() >= 6
