"""All registered queries at the smallest scale: same rows as their SQL, and no all-pairs join in any plan."""

import os

import pytest

from compare import compare, connect
from contactloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    problem, n, _, df = compare(spark, duck, SF, catalog.QUERIES[name], catalog.ORACLE.get(name))
    assert problem is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_validation_scores_each_row_once(spark):
    """The measures read written scores; none of them runs the model again."""
    plan = catalog.QUERIES["m08_validate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "_features" not in plan
