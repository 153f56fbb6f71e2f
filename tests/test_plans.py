"""Physical-plan checks: pushdown, pruning, no row-at-a-time Python, no
cartesian products, no unpartitioned windows over data-sized inputs."""

import re

import pytest

from kipmart import registry
from kipmart.operators import reports as R

from conftest import SF_SMALL

QUERIES = registry.queries()


def _plan(df, mode="formatted"):
    return df._jdf.queryExecution().executedPlan().toString() if mode == "exec" else \
        df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_month_filter_reaches_parquet(shop):
    plan = _plan(R.sales_summary(shop, "1998-03"))
    pushed = [ln for ln in plan.splitlines() if "PushedFilters" in ln]
    assert any("GreaterThanOrEqual(o_orderdate" in ln and "LessThan(o_orderdate" in ln for ln in pushed)


def test_line_scan_reads_only_needed_columns(spark):
    from kipmart.registry import _shop
    plan = _plan(R.top_products(_shop(spark, SF_SMALL)))
    schemas = [ln for ln in plan.splitlines() if "ReadSchema" in ln and "order_id" in ln]
    assert schemas
    for ln in schemas:
        assert "is_preorder" not in ln and "id:" not in ln.replace("_id:", "")
    orders = [ln for ln in plan.splitlines() if "ReadSchema" in ln and "status" in ln]
    assert orders and all("total_amount" not in ln for ln in orders)
    # on the stored shop tables the live-order predicate is pushed to the scan
    assert any("Not(EqualTo(status,cancelled))" in ln for ln in plan.splitlines()
               if "PushedFilters" in ln)


def test_lines_are_aggregated_before_the_product_join(shop):
    plan = _plan(R.top_products(shop))
    # the partial aggregate on product_id sits below the join with the products
    assert re.search(r"HashAggregate.*\n(.*\n)*.*Join", plan)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf_or_cartesian_product(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{key}: {bad}"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_windows_only_over_partition_summaries(spark, key):
    """No query runs a window over data rows (a hot key would land in one
    task). The only windows are over per-partition summaries of the numbering
    helpers (one row per partition, ordered by partition index)."""
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    for ln in plan.splitlines():
        if ln.strip().startswith("Arguments") and "windowspecdefinition" in ln:
            assert "__pid" in ln, f"{key}: {ln}"
