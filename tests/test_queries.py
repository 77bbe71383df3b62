"""Registered queries beside their SQL, with plans that stay in the JVM where nothing else is stated."""

import pytest

from sessionloom.plans import catalog

from .oracles import compare, connect

SF = "/root/testdata/sf0.001"
#: Queries whose semantics are a sequential fold or an automaton in Python, or a stream.
PYTHON = ("lim_05b", "udf_01", "hi_14", "hi_07b", "src_07b", "jn_07", "str_")


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, connection, name):
    assert compare(spark, connection, name, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if not n.startswith((*PYTHON, "snk_"))))
def test_plan_stays_in_the_jvm(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
