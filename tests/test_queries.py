"""Every registered query against its SQL, and the shape of the main plans."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql
from __spark_entry__ import queries as all_queries
from cohortkit.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def queries():
    """The library's own queries; those of the optional corpus operators have tests of their own."""
    return QUERIES


def test_every_query_has_sql():
    assert set(queries()) <= set(oracle_sql()) and set(queries()) <= set(all_queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    assert oracle.difference(queries()[name](spark, SF), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in queries() if n.startswith(("panel", "extract", "metric", "qc"))))
def test_no_cross_products(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
