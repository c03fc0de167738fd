import datetime as dt
import gzip

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.functions import frames
from cohortkit.plans import collect
from cohortkit.sources import readers, tables, writers


def frame(spark, rows, schema="id long, m int"):
    return spark.createDataFrame(rows, schema)


# ---- partition replacement and period loads ----


def test_replace_keeps_other_partitions(spark, rows):
    writers.replace_partitions(frame(spark, [(1, 1), (2, 2)]), "t.replace", "m")
    for _ in range(2):
        writers.replace_partitions(frame(spark, [(3, 2), (4, 2)]), "t.replace", "m")
        assert rows(spark.table("t.replace")) == [(1, 1), (3, 2), (4, 2)]


def test_requested_period_without_rows_ends_empty(spark, rows):
    writers.replace_partitions(frame(spark, [(1, 1), (2, 2), (3, 3)]), "t.empty_period", "m")
    writers.replace_partitions(frame(spark, [(9, 1)]), "t.empty_period", "m", requested=[1, 2])
    assert rows(spark.table("t.empty_period")) == [(3, 3), (9, 1)]
    writers.replace_partitions(frame(spark, [(9, 1)]).where("id < 0"), "t.empty_period", "m", requested=[1, 2])
    assert rows(spark.table("t.empty_period")) == [(3, 3)]
    writers.replace_partitions(frame(spark, []), "t.empty_period", "m", requested=[3])
    assert rows(spark.table("t.empty_period")) == []


def test_replace_by_column_name_and_text_partition(spark, rows):
    writers.replace_partitions(frame(spark, [("a", 1)], "m string, id long"), "t.by_name", "m")
    writers.replace_partitions(frame(spark, [(2, "b")], "id long, m string"), "t.by_name", "m", requested=["a", "b"])
    assert rows(spark.table("t.by_name"), "id", "m") == [(2, "b")]


def test_replace_leaves_the_session_setting_alone(spark, rows):
    key = "spark.sql.sources.partitionOverwriteMode"
    writers.replace_partitions(frame(spark, [(1, 1), (2, 2)]), "t.setting", "m")
    spark.conf.set(key, "static")
    try:
        writers.replace_partitions(frame(spark, [(3, 1)]), "t.setting", "m")
        assert spark.conf.get(key) == "static"
    finally:
        spark.conf.set(key, "dynamic")
    assert rows(spark.table("t.setting")) == [(2, 2), (3, 1)]


def test_a_failing_source_loses_nothing(spark, shipped, year2000, rows):
    collect.collect_periods(spark, shipped, "t.safe", 200001, 200002, year2000)
    before = rows(spark.table("t.safe"))
    no = F.raise_error(F.lit("no"))
    for bad in (shipped.withColumn("id", no.cast("long")), shipped.withColumn("other", no.cast("long"))):
        with pytest.raises(Exception, match="no"):
            collect.collect_periods(spark, bad, "t.safe", 200001, 200003, year2000)
        assert rows(spark.table("t.safe")) == before
    with pytest.raises(Exception, match="no"):
        collect.add_partition(spark, shipped.withColumn("id", no.cast("long")), "t.safe", "month_id", 200001)
    assert rows(spark.table("t.safe")) == before


def test_a_source_that_reads_its_target_is_refused(spark, shipped, year2000):
    collect.collect_periods(spark, shipped, "t.own", 200001, 200002, year2000)
    with pytest.raises(ValueError):
        collect.collect_periods(spark, "select * from t.own where id > 1", "t.own", 200001, 200002, year2000)
    assert spark.table("t.own").count() == 3


def test_initial_load_with_other_columns_swaps_the_table(spark, shipped, year2000, rows):
    collect.collect_periods(spark, shipped, "t.wider", 200001, 200002, year2000)
    got = collect.collect_periods(spark, shipped.withColumn("extra", F.lit("e")), "t.wider", 200002, 200003, year2000)
    assert rows(got, "id", "extra", "month_id") == [(4, "e", 200002), (6, "e", 200003)]
    assert [r[0] for r in spark.sql("SHOW TABLES IN t LIKE 'wider_*'").collect()] == []


def test_period_column_in_upper_case(spark, shipped, year2000, rows):
    upper = shipped.withColumnsRenamed({"month_id": "MONTH_ID", "week_id": "WEEK_ID"})
    for _ in range(2):
        got = collect.collect_periods(spark, upper, "t.upper_case", 200001, 200002, year2000)
        assert rows(got, "id") == [(1,), (2,), (4,)]
    assert rows(collect.add_partition(spark, upper.where("id = 5"), "t.upper_case", "month_id", 200002), "id") == [(1,), (2,), (5,)]


def test_add_partition_twice_is_the_same(spark, rows):
    data = frame(spark, [(1, 1), (2, 2)])
    for _ in range(2):
        assert rows(collect.add_partition(spark, data, "t.twice", "m", 1)) == [(1, 1), (2, 2)]


def test_save_from_a_query(spark, rows):
    frame(spark, [(1, 1), (2, 2)]).createOrReplaceTempView("to_save")
    assert writers.save_table("select * from to_save where m = 2", "t.from_query", "m", spark=spark, cache=True) == 1
    assert rows(spark.table("t.from_query")) == [(2, 2)]


@pytest.fixture
def shipped(spark):
    data = [(1, 20000107, 200001), (2, 20000204, 200001), (3, 20000211, 200001), (4, 20000211, 200002), (5, None, 200002), (6, 20000310, 200003)]
    return frame(spark, data, "id long, week_id int, month_id int")


def test_collect_months(spark, shipped, year2000, rows):
    got = collect.collect_periods(spark, shipped, "t.months", 200001, 200002, year2000)
    assert rows(got, "id") == [(1,), (2,), (4,)]
    for _ in range(2):
        got = collect.collect_periods(spark, shipped, "t.months", 200002, 200003, year2000, method="APPEND", files=2)
        assert rows(got, "id", "month_id") == [(1, 200001), (2, 200001), (4, 200002), (6, 200003)]
    got = collect.collect_periods(spark, shipped.where("id > 5"), "t.months", 200001, 200002, year2000, method="APPEND")
    assert rows(got, "id") == [(6,)]
    got = collect.collect_periods(spark, shipped, "t.months", 200003, 200003, year2000)
    assert rows(got, "id") == [(6,)]


def test_collect_months_without_week_column(spark, shipped, year2000, rows):
    got = collect.collect_periods(spark, shipped.drop("week_id"), "t.months_only", 200001, 200001, year2000, method="APPEND")
    assert rows(got, "id") == [(1,), (2,), (3,)]


def test_collect_from_query_with_upper_case_week(spark, shipped, year2000, rows):
    shipped.withColumnRenamed("week_id", "WEEK_ID").createOrReplaceTempView("shipped_v")
    got = collect.collect_periods(spark, "select * from shipped_v", "t.months_sql", 200001, 200001, year2000)
    assert rows(got, "id") == [(1,), (2,)]


def test_collect_weeks(spark, shipped, year2000, rows):
    got = collect.collect_periods(spark, shipped, "t.weeks", 20000201, 20000218, year2000, period="week_id")
    assert rows(got, "id") == [(2,), (3,), (4,)]
    with pytest.raises(ValueError):
        collect.collect_periods(spark, shipped, "t.weeks", 20000201, 20000218, year2000, method="REPLACE")


def test_add_partition(spark, rows):
    for _ in range(2):
        collect.add_partition(spark, frame(spark, [(1, 1)]), "t.added", "m", 1)
    got = collect.add_partition(spark, frame(spark, [(2, 1)]), "t.added", "m", 1, method="APPEND")
    assert rows(got) == [(1, 1), (2, 1)]


def test_save_cohorts(spark, rows):
    collect.save_cohorts(frame(spark, [(1, 1), (2, 2)], "id long, cohort_id long"), "t.cohorts")
    got = collect.save_cohorts(frame(spark, [(3, 2)], "id long, cohort_id long"), "t.cohorts")
    assert rows(got) == [(1, 1), (3, 2)]


# ---- tables ----


def test_save_modes(spark, rows):
    data = frame(spark, [(1, 1), (2, 2)])
    assert writers.save_table(data, "t.saved", "M", upper=True, files=3, analyze=True) == 2
    assert spark.table("t.saved").columns == ["ID", "M"]
    assert [r[0] for r in spark.sql("SHOW PARTITIONS t.saved").collect()] == ["M=1", "M=2"]
    assert writers.save_table(data, "t.saved", "m", upper=True, cache=True) == 2
    assert spark.table("t.saved").count() == 4
    assert writers.save_table(data, "t.saved", mode="overwrite") == 2
    assert writers.save_table(data, "t.saved_plain", "missing", files=1) == 2


def test_file_count_is_bounded(spark):
    data = spark.range(400).selectExpr("id", "cast(id % 2 as int) as m").repartition(8)
    writers.save_table(data, "t.files", "m", files=2)
    per_partition = spark.table("t.files").select("m", F.input_file_name().alias("f")).distinct().groupBy("m").count()
    assert all(r["count"] <= 2 for r in per_partition.collect())


def test_run_insert(spark):
    writers.save_table(frame(spark, [(1, 1)]), "t.ins")
    assert writers.run_insert(spark, "t.ins", "INSERT INTO t.ins VALUES (5, 6), (7, 8)") == 3


@pytest.mark.parametrize("partition", ["m", None])
def test_compact_and_dedupe(spark, rows, partition):
    name = f"t.compact_{partition}"
    for _ in range(3):
        writers.save_table(frame(spark, [(1, 1), (2, 2)]).repartition(2), name, partition)
    tables.compact(spark, name, partition)
    assert rows(spark.table(name)) == [(1, 1)] * 3 + [(2, 2)] * 3
    assert spark.table(name).select(F.input_file_name()).distinct().count() <= 2
    assert rows(tables.partition_counts(spark, name, "m")) == [(1, 3), (2, 3)]
    tables.dedupe(spark, name, partition)
    assert rows(spark.table(name)) == [(1, 1), (2, 2)]
    assert not [t for t in spark.catalog.listTables("t") if t.name.startswith(f"compact_{partition}_".lower())]


def _files(spark, name):
    files = spark.table(name).select("m", F.col("_metadata.file_path").alias("f")).distinct()
    return {r.m: set(r.f) for r in files.groupBy("m").agg(F.collect_set("f").alias("f")).collect()}


def test_compact_leaves_well_sized_partitions(spark, rows):
    data = frame(spark, [(i, i % 3) for i in range(300)] + [(5, None), (8, None)])
    writers.save_table(data.where("m = 1"), "t.sizes", "m", files=1)
    for k in range(3):
        writers.save_table(data.where(f"(m <> 1 OR m IS NULL) AND floor(id / 3) % 3 = {k}"), "t.sizes", "m", files=1)
    before, held = _files(spark, "t.sizes"), rows(spark.table("t.sizes"))
    assert sorted(map(repr, tables.compact(spark, "t.sizes", "m"))) == ["0", "2", "None"]
    after = _files(spark, "t.sizes")
    assert rows(spark.table("t.sizes")) == held
    assert after[1] == before[1] and {m: len(f) for m, f in after.items()} == dict.fromkeys(before, 1)
    # Nothing is left to do, and a target below the sizes asks for more files.
    assert tables.compact(spark, "t.sizes", "m") == [] and _files(spark, "t.sizes") == after
    assert tables.compact(spark, "t.sizes", "m", files_per_partition=1) == []


def test_compact_packs_to_a_target(spark):
    data = spark.range(40_000).selectExpr("id", "sha2(string(id), 256) as note", "cast(id % 2 as int) as m")
    for k in range(8):
        writers.save_table(data.where(f"floor(id / 2) % 8 = {k}"), "t.packed", "m", files=1)
    target = 400_000
    assert sorted(tables.compact(spark, "t.packed", "m", target_bytes=target)) == [0, 1]
    sizes = spark.table("t.packed").select("m", "_metadata.file_path", "_metadata.file_size").distinct().collect()
    assert all(target / 3 < r.file_size < 1.5 * target for r in sizes) and len(sizes) < 16
    assert spark.table("t.packed").distinct().count() == 40_000


def test_dedupe_leaves_partitions_without_repeated_rows(spark, rows):
    data = frame(spark, [(i, m) for m in (1, 2, None) for i in range(50)])
    writers.save_table(data, "t.repeated", "m", files=1)
    writers.save_table(data.where("m = 2 AND id < 9"), "t.repeated", "m", files=1)
    before = _files(spark, "t.repeated")
    assert tables.dedupe(spark, "t.repeated", "m") == [2]
    after = _files(spark, "t.repeated")
    assert rows(spark.table("t.repeated")) == rows(data) and after[1] == before[1] and after[None] == before[None]
    assert tables.dedupe(spark, "t.repeated", "m") == []
    writers.save_table(data.where("m IS NULL"), "t.repeated", "m")
    assert tables.dedupe(spark, "t.repeated", "m") == [None] and rows(spark.table("t.repeated")) == rows(data)


def test_statistics_of_written_partitions_only(spark, rows):
    data = frame(spark, [(i, i % 3) for i in range(30)] + [(1, None)])
    writers.replace_partitions(data, "t.counted", "m")
    told = lambda: {r.partition: r.rows for r in tables.partition_statistics(spark, "t.counted").collect()}
    assert told() == {"0": None, "1": None, "2": None, None: None}
    collect.add_partition(spark, data.where("m = 1 AND id < 9"), "t.counted", "m", 1)
    assert told() == {"0": None, "1": 3, "2": None, None: None}
    collect.add_partition(spark, data.where("m = 2 OR m IS NULL"), "t.counted", "m", 2, method="APPEND")
    # Spark counts the bytes, not the rows, of the partition without a value.
    assert told() == {"0": None, "1": 3, "2": 20, None: None}
    assert all((r.bytes or 0) > 0 for r in tables.partition_statistics(spark, "t.counted").where("rows IS NOT NULL").collect())


def test_a_failing_swap_leaves_the_old_table(spark, rows):
    writers.save_table(frame(spark, [(1, 1)]), "t.stays", "m")
    with pytest.raises(Exception, match="made_nowhere"):
        writers.swap_in(spark, "t.made_nowhere", "t.stays")
    assert rows(spark.table("t.stays")) == [(1, 1)]
    assert [r[1] for r in spark.sql("SHOW TABLES IN t LIKE 'stays*'").collect()] == ["stays"]


def test_upkeep(spark, rows):
    data = frame(spark, [(1, 1), (2, 2)])
    writers.create_like(data.select("m", "id"), "t.upkeep", "m")
    assert spark.table("t.upkeep").columns == ["id", "m"] and spark.table("t.upkeep").count() == 0
    assert tables.exists(spark, "T.UPKEEP") and not tables.exists(spark, "t.none")
    assert tables.database_exists(spark, "t") and not tables.database_exists(spark, "nowhere")
    writers.insert_by_name(data, "t.upkeep")
    assert tables.analyze(spark, "t.upkeep", "m", 1) == 2
    tables.drop_partition(spark, "t.upkeep", "m", 1)
    tables.drop_partition(spark, "t.upkeep", "m", 77)
    assert rows(spark.table("t.upkeep")) == [(2, 2)]
    assert tables.preview(spark.table("t.upkeep"), 5).values.tolist() == [[2, 2]]
    tables.truncate(spark, "t.upkeep")
    assert spark.table("t.upkeep").count() == 0
    tables.drop(spark, "t.upkeep")
    tables.drop(spark, "t.upkeep")
    assert not tables.exists(spark, "t.upkeep")


# ---- sources ----


def test_resolve(spark, rows):
    data = frame(spark, [(1, 1)])
    writers.save_table(data, "t.named")
    assert readers.resolve(spark, data) is data
    assert rows(readers.resolve(spark, "t.named")) == [(1, 1)]
    assert rows(readers.resolve(spark, "named", "t")) == [(1, 1)]
    assert rows(readers.resolve(spark, "-- note\n/* more\n */ with x as (select 5 as a) select a from x")) == [(5,)]
    assert rows(readers.resolve(spark, "SELECT\n7 as a -- end")) == [(7,)]
    assert readers.resolve(spark, 5) is None
    writers.save_table(data, "selected_things", mode="overwrite")
    assert rows(readers.resolve(spark, "selected_things", "nowhere")) == [(1, 1)]
    tables.drop(spark, "selected_things")


def test_csv(spark, rows, tmp_path):
    out = str(tmp_path / "out")
    writers.write_csv(frame(spark, [(1, 2), (3, None)]).withColumnRenamed("id", "ID"), out, sep=";", compression="gzip")
    got = readers.read_csv_dir(spark, out, sep=";", pattern="*.csv.gz", partitions=1)
    assert got.columns == ["id", "m"] and got.rdd.getNumPartitions() == 1
    assert rows(got) == [(1, 2), (3, None)]
    frame(spark, [(8, 9)]).createOrReplaceTempView("exported")
    writers.write_csv("select * from exported", out, spark=spark)
    assert rows(readers.read_csv_dir(spark, out, schema="id long, m int")) == [(8, 9)]


def test_many_gzip_files(spark, rows, tmp_path):
    for i in range(3):
        with gzip.open(tmp_path / f"part{i}.csv.gz", "wt") as f:
            f.write(f"a,b\n{i},x{i}\n")
    (tmp_path / "other.txt").write_text("a,b\n9,9\n")
    assert rows(readers.read_csv_dir(spark, str(tmp_path), pattern="*.csv.gz")) == [(0, "x0"), (1, "x1"), (2, "x2")]


def test_parquet_dirs(spark, rows, tmp_path):
    for i in range(2):
        frame(spark, [(i, i)]).write.parquet(str(tmp_path / str(i)))
    assert rows(readers.read_parquet(spark, str(tmp_path / "0"))) == [(0, 0)]
    assert rows(readers.read_parquet(spark, [str(tmp_path / "0"), str(tmp_path / "1")])) == [(0, 0), (1, 1)]


def test_from_pandas(spark):
    pdf = pd.DataFrame({"i": [1, 2], "f": [0.1, None], "s": ["x", None], "b": [True, False], "t": pd.to_datetime(["2024-01-01", None])})
    pdf["d"] = pdf["t"]
    pdf["n"] = pdf["i"].astype("int32")
    got = readers.from_pandas(spark, pdf, dates=["d"])
    assert [f.dataType for f in got.schema] == [T.LongType(), T.DoubleType(), T.StringType(), T.StringType(), T.TimestampType(), T.DateType(), T.IntegerType()]
    first, second = got.orderBy("i").collect()
    assert tuple(first) == (1, 0.1, "x", "True", dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), 1)
    assert (second.s, second.b, second.t, second.d) == (None, "False", None, None)


def test_jdbc_options():
    assert readers.jdbc_options("u", "(select 1) q", fetchsize=5, session_init="BEGIN END;") == {
        "url": "u",
        "dbtable": "(select 1) q",
        "fetchsize": "5",
        "sessionInitStatement": "BEGIN END;",
    }
    split = readers.jdbc_options("u", "t", partition_column="k", lower_bound=0, upper_bound=9, num_partitions=4)
    assert split == {"url": "u", "dbtable": "t", "partitionColumn": "k", "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}
    with pytest.raises(ValueError):
        readers.jdbc_options("u", "t", partition_column="k")


class Recorder:
    """Stands in for a reader or writer and notes the calls."""

    def __init__(self, result=None):
        self.calls, self.result = {}, result

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls[name] = kwargs or args
            return self.result if name in ("load", "save") else self

        return call


def test_jdbc_read_lower_cases(spark):
    class Session:
        read = Recorder(frame(spark, [(1, 2)], "ID long, M int"))

    assert readers.read_jdbc(Session, "u", "t", fetchsize=7).columns == ["id", "m"]
    assert Session.read.calls["format"] == ("jdbc",) and Session.read.calls["options"] == {"url": "u", "dbtable": "t", "fetchsize": "7"}
    assert readers.read_jdbc(Session, "u", "t", lowercase=False).columns == ["ID", "M"]


def test_copy_table(spark, rows, monkeypatch):
    monkeypatch.setattr(writers, "read_jdbc", lambda session, url, source, **options: frame(spark, [(1, 5), (2, 6)]))
    for _ in range(2):
        assert writers.copy_table(spark, "u", "OWNER.COPIED", "t", partition="m") == "t.copied"
    assert rows(spark.table("t.copied")) == [(1, 5), (2, 6)]
    assert [r[0] for r in spark.sql("SHOW PARTITIONS t.copied").collect()] == ["m=5", "m=6"]


def test_jdbc_write_mode(spark):
    with pytest.raises(ValueError):
        writers.write_jdbc(frame(spark, []), "u", "t", mode="refresh")


def test_copy_target(spark):
    assert writers.copy_target(spark, "OWNER.CLAIMS", None, "base") == "base.claims"
    assert writers.copy_target(spark, "OWNER.CLAIMS", "T", "base") == "t.claims"
    assert writers.copy_target(spark, "CLAIMS", "mine", "base") == "base.mine"
    assert writers.copy_target(spark, "CLAIMS", "A.B", "base") == "a.b"
    with pytest.raises(ValueError):
        writers.copy_target(spark, "CLAIMS", "a.b.c", "base")


# ---- frames ----


def test_frames(spark, rows):
    data = spark.createDataFrame([(None,), (" R",), ("abc",)], "c string")
    assert sorted(r.v for r in data.select(frames.clean_code("c").alias("v")).collect()) == ["R", "a", "z"]
    assert frames.upper_columns(data).columns == ["C"] and frames.lower_columns(frames.upper_columns(data)).columns == ["c"]
    wide = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert frames.select_existing(wide, ["c", "a", "x"]).columns == ["a", "c"]
    left, right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "v int"), spark.createDataFrame([(2,), (4,), (4,)], "v int")
    assert rows(frames.symmetric_difference(left, right)) == sorted([(1,), (4,), (None,)], key=repr)
    assert frames.to_pandas(wide, partitions=2).values.tolist() == [[1, 2, 3]]
