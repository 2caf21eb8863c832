"""Every registered query on the smallest tables: its plan, and its result against SQL."""

import pytest

import __spark_entry__ as contract
from registry.tables import QUERIES, SQL
from tests.compare import connect, differences, plan_of

FOLDER = "/root/testdata/sf0.001"
PYTHON = {"isolation_forest", "isolation_forest_salted", "detector_run", "forest_by_saved_model"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "MapInPandas" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "Pandas" not in plan
    if name in SQL:
        assert differences(df, con, SQL[name]) is None
    else:
        assert len(df.collect()) > 0


def test_all_are_registered():
    assert QUERIES.items() <= contract.queries().items() and SQL.items() <= contract.oracle_sql().items()


def test_entry(spark):
    assert contract.entry(spark).columns == ["rank", "corredor", "icv_medio", "icv_maximo", "n_registros"]
