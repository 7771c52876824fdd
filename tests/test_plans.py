"""Plan-shape checks on the registered queries (no execution needed)."""

import re

import pytest

from funnelkit.plans.registry import QUERIES
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan(q(spark, SF_SMALL)) for k, q in QUERIES.items()
            if k not in ("csv_round_trip", "arrival_order")}


def test_no_python_udfs(plans):
    for k, p in plans.items():
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                     "MapInPandas", "PythonUDF"):
            assert node not in p, (k, node)


def test_no_cartesian_product_over_rows(plans):
    for k, p in plans.items():
        assert "CartesianProduct" not in p, k


def test_stage_filter_reaches_the_orders_scan(plans):
    p = plans["weekly_kpis"]
    scan = [line for line in p.splitlines() if "orders.parquet" in line][0]
    assert "o_orderpriority" in scan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz," \
           "o_orderpriority:string>" in scan


def test_column_pruning_on_lineitem(plans):
    p = plans["funnel"]
    scan = [line for line in p.splitlines() if "lineitem.parquet" in line][0]
    assert "l_extendedprice" not in scan and "l_shipdate" not in scan


def test_dedup_uses_group_limit(plans):
    assert "WindowGroupLimit" in plans["dedup_orders"]


def test_orphan_check_skips_price_statistics(spark):
    from funnelkit.operators import clean, quality
    from funnelkit.sources import fixtures as fx
    capped = clean.cap_price_outliers(fx.raw_products(spark, SF_SMALL))
    orders = fx.raw_orders(spark, SF_SMALL)
    p = plan(quality.orphans(orders, capped, "product_id"))
    assert "Subquery" not in p and "rangepartitioning" not in p


_AGG = ("HashAggregate", "SortAggregate", "ObjectHashAggregate")


def _nodes(plan_text):
    """(depth, name) for each operator line of a plan tree string."""
    out = []
    for line in plan_text.splitlines():
        stripped = line.lstrip(" :+-|")
        if not stripped:
            continue
        name = re.match(r"[*()0-9 ]*([A-Za-z]*)", stripped).group(1)
        out.append((len(line) - len(stripped), name))
    return out


def _raw_rows_into_one_partition(p):
    """Operators that feed un-aggregated rows into a SinglePartition exchange."""
    nodes, lines, bad = _nodes(p), p.splitlines(), []
    lines = [ln for ln in lines if ln.lstrip(" :+-|")]
    for i, (depth, name) in enumerate(nodes):
        if name != "Exchange" or "SinglePartition" not in lines[i]:
            continue
        for d2, n2 in nodes[i + 1:]:
            if d2 <= depth or n2 in _AGG or n2 in ("LocalLimit", "TakeOrderedAndProject"):
                break
            if n2 in ("FileScan", "Scan", "Range", "Exchange", "BroadcastHashJoin",
                      "SortMergeJoin"):
                bad.append(n2)
                break
    return bad


def test_plan_check_catches_a_global_window_over_rows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(10).withColumn("prev", F.lag("id").over(Window.orderBy("id")))
    assert _raw_rows_into_one_partition(plan(df))


def test_single_partition_exchanges_only_see_aggregated_rows(plans):
    """Windows without PARTITION BY and global aggregates get aggregated rows."""
    for k, p in plans.items():
        assert not _raw_rows_into_one_partition(p), k


def test_stage_predicate_pushed_into_parquet_on_cleaned_tables(spark, tmp_path):
    """On stored cleaned tables the stage filter is a Parquet pushed filter."""
    import datetime as dt

    from funnelkit.operators import dropoff, metrics
    orders = spark.createDataFrame(
        [(1, 1, 1, 2, "Purchased", dt.datetime(2024, 1, 3))],
        "order_id long, user_id long, product_id long, quantity long, "
        "order_stage string, order_date timestamp_ntz")
    products = spark.createDataFrame([(1, "a", 2.0)],
                                     "product_id long, product_name string, base_price double")
    users = spark.createDataFrame([(1, "EU", "web")],
                                  "user_id long, region string, channel string")
    paths = {}
    for name, df in (("orders", orders), ("products", products), ("users", users)):
        paths[name] = str(tmp_path / name)
        df.write.parquet(paths[name])
    o, p, u = (spark.read.parquet(paths[n]) for n in ("orders", "products", "users"))
    kpi = plan(metrics.weekly_kpis(o, p))
    assert "EqualTo(order_stage,Purchased)" in kpi
    drop = plan(dropoff.checkout_dropoff(o, u))
    assert "In(order_stage, [Checkout Initiated,Purchased])" in drop
