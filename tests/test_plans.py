"""Plan shape checks: top-k, scans, pushdown, no Python in plain plans."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from matflow.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["top_stock", "lowest_stock", "latest_created", "top_production_qty"])
def test_topk_uses_take_ordered(spark, name):
    p = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" in p
    phys = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "TakeOrderedAndProject" in phys


def test_kpis_scan_each_table_once(spark):
    phys = registry.QUERIES["dashboard_kpis"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert phys.count("FileScan parquet") == 2


def test_point_lookup_pushed_down(spark):
    phys = registry.QUERIES["stock_by_id"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,42)]" in phys


def test_retention_prunes_partitions(spark):
    import re
    phys = registry.QUERIES["audit_retention"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", phys).group(1)
    # whole days before the cut-off and batches outside the version are never read
    assert "audit_date" in filters and "batch" in filters


@pytest.mark.parametrize("name", ["dashboard_kpis", "production_with_material", "stock_usage",
                                  "status_share", "audit_with_role", "validate_production_requests",
                                  "capture_production_changes", "rate_limit_windows"])
def test_no_python_in_plain_plans(spark, name):
    phys = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "BatchEvalPython" not in phys and "ArrowEvalPython" not in phys


def test_no_cartesian_product(spark):
    for name, fn in registry.QUERIES.items():
        if name == "consume_stock_stream":   # runs a whole stream; the plan it returns is a scan
            continue
        phys = fn(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" not in phys and "BroadcastNestedLoopJoin" not in phys, name
