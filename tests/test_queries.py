"""Registered queries against DuckDB on the smallest tables, and what their plans hold."""

import importlib.util
import os

import oracle
import pytest

from tillroll.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CHECKED = sorted(registry.oracle_sql())
UNCHECKED = sorted(set(registry.queries()) - set(CHECKED))


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    assert oracle.compare(df, duck, registry.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", UNCHECKED)
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
