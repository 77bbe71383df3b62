"""What the cost of rows carries through its join."""

from sessionloom.plans import catalog


def test_usage_is_computed_after_the_join_by_row(spark):
    plan = catalog.queries()["agg_11_cost"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    _, below = plan.split("Join Inner", 1)
    assert "named_struct(input" not in below and "RepartitionByExpression [event_id" in below
