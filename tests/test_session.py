import os

from cohortkit import session


class Session:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_configured_folder_is_used():
    assert session.shared_dir(Session(spark_checkpoint_dir="hdfs://shared/ck", spark_sql_warehouse_dir="hdfs://w")) == "hdfs://shared/ck"


def test_the_warehouse_is_used_without_a_folder():
    assert session.shared_dir(Session(spark_checkpoint_dir=None, spark_sql_warehouse_dir="hdfs://w")) == "hdfs://w"


def test_scratch_paths_differ_and_lie_in_the_shared_folder(spark):
    paths = {session.scratch_path(spark, "x") for _ in range(2)}
    assert len(paths) == 2 and all(p.startswith(session.shared_dir(spark)) for p in paths)


def test_a_written_table_keeps_rows_and_cuts_lineage(spark):
    cut = session.written(spark.range(5))
    assert sorted(r.id for r in cut.collect()) == list(range(5))
    assert "Range" not in cut._jdf.queryExecution().executedPlan().toString()
    assert os.path.isdir(session.shared_dir(spark).removeprefix("file:"))
