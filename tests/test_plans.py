"""Plan shape checks: pushdown, no cartesian products, no single-partition windows
in the flagship query."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_shape(spark):
    plan = _plan(E.queries()["note_change"](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_pruning(spark):
    df = E.queries()["resolve_revisions"](spark, SF)
    plan = _plan(df)
    # only the needed columns of orders are read
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan
