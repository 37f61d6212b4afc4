"""Physical plans: pushdown, pruning, no cross joins, no Python where none is needed."""

import pytest

from trafficlens.plans import catalog
from trafficlens.operators import paging, usage
from trafficlens.plans.usage_catalog import AS_OF
from trafficlens.sources import tables
from trafficlens.sources.driver_views import view

SQL_ONLY = [
    n for n in catalog.queries()
    if not any(w in n for w in ("rate_limit_by", "rate_limit_dec", "exact_cache", "semantic", "stream", "embed", "nearest", "funnel",
                                "hash_classes", "sweep", "attach", "store"))
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SQL_ONLY)
def test_no_cross_join_and_no_python(spark, sf, name):
    p = plan(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Python" not in p and "Pandas" not in p


def test_day_folders_and_row_groups_are_pruned(spark, sf, tmp_path):
    path = str(tmp_path / "usage")
    tables.append_usage(view(spark, sf, "usage_logs"), path)
    df = tables.load_usage(spark, path, "2024-01-30 00:00:00", AS_OF)
    p = plan(usage.overview_totals(df, AS_OF))
    assert "PartitionFilters: [isnotnull(dt" in p and "GreaterThanOrEqual(created_at" in p
    schema = p[p.index("ReadSchema: ") :].split("\n")[0]
    assert "error" not in schema and "model" not in schema
    # one file per day and writer task, never one per row group of the input
    assert len(list((tmp_path / "usage").glob("dt=*"))) == 30


def test_filter_reaches_the_scan(spark, sf):
    p = plan(usage.errors_hourly(view(spark, sf, "usage_logs"), AS_OF))
    assert "GreaterThanOrEqual(ts" in p and "LessThanOrEqual(ts" in p


def test_pages_are_top_k(spark, sf):
    u = view(spark, sf, "usage_logs")
    assert "TakeOrderedAndProject" in plan(paging.newest_page(u))
    p = plan(paging.newest_page_after(u, ("2024-01-20 00:00:00", 5)))
    assert "TakeOrderedAndProject" in p and "LessThanOrEqual(ts" in p


def test_usage_rollup_scans_once(spark, sf):
    u = view(spark, sf, "usage_logs")
    assert plan(usage.usage_rollup(u)).count("FileScan") == 1
    assert plan(usage.latency_by_layer(u, AS_OF, hours=744)).count("FileScan") == 1
    assert plan(usage.traffic_mix(u)).count("FileScan") == 1


def test_aggregates_combine_before_the_shuffle(spark, sf):
    p = plan(usage.usage_daily(view(spark, sf, "usage_logs")))
    assert "partial_sum" in p


def test_hot_keys_are_packed_before_they_meet(spark, sf):
    """A hot key reaches the task that follows it as one row per cell, not as its raw rows."""
    from trafficlens.operators.exact_cache import replay_exact_cache
    from trafficlens.operators.ratelimit import replay_rate_limit

    rows = view(spark, sf, "requests_flat")
    p = plan(replay_rate_limit(rows, per_short=1, hot_rows=0))
    assert "hashpartitioning(key" in p and "island" in p and "collect_list(struct(ms" in p
    p = plan(replay_exact_cache(rows, key="k", hot_rows=0))
    assert "collect_list(struct(ms" in p and "LeftAnti" in p
