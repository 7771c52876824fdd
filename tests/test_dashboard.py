"""Widgets from stored partials equal the ones planned on the tables, for any segments."""

import random

import pytest

from funnelkit.plans.dashboard import build_partials, dashboard, dashboard_from
from funnelkit.sources import fixtures as fx
from tests.conftest import SF_SMALL, rows


def _tables(spark, seed, n=400):
    rng = random.Random(seed)
    regions, channels = ["EU", "US", None, "O'Brien"], ["web", "ads", None]
    users = [(u, rng.choice(regions), rng.choice(channels)) for u in range(30)]
    users += [(3, "EU", "web"), (4, "US", "ads"), users[5], (None, "EU", "web")]   # two rows for some users
    products = [(p, "p", rng.choice([1.5, 0.07, 1e13, 4e-7, None, float("nan")])) for p in range(12)] + [(1, "again", 2.0)]
    stages = ["Visited", "Added to Cart", "Checkout Initiated", "Purchased", "Purchased", "Lost", None]
    orders = [(rng.choice([None, *range(120)]), rng.choice([None, *range(33)]), rng.choice([None, *range(14)]),
               rng.choice([None, 0, 1, 10**9, -2]), rng.choice(stages),
               rng.choice([None, "2024-12-30 10:00:00", "2024-01-03 10:00:00", "2024-06-05 23:59:59"]))
              for _ in range(n)]
    return (spark.createDataFrame(orders, "order_id long, user_id long, product_id long, quantity long, "
                                          "order_stage string, order_date string")
            .selectExpr("* EXCEPT (order_date)", "CAST(order_date AS timestamp_ntz) AS order_date"),
            spark.createDataFrame(products, "product_id long, product_name string, base_price double"),
            spark.createDataFrame(users, "user_id long, region string, channel string"))


CHOICES = [(None, None), (["EU"], None), (["EU", "O'Brien"], ["web"]), ([], ["ads"]), (["NOWHERE"], None)]


@pytest.mark.parametrize("seed, n", [(1, 400), (2, 400), (3, 0)])
def test_partials_equal_the_tables(spark, tmp_path, seed, n):
    orders, products, users = _tables(spark, seed, max(n, 1))
    if not n:
        orders = orders.limit(0)
    path = str(tmp_path / "partials")
    build_partials(orders, products, users, path)
    schema = ("region string, channel string, year long, week_num long, base_price double, order_stage string, "
              "order_id long, user_id long, _q long, _first date, _last date, _sold boolean, _began boolean, "
              "_bought boolean, _part string")
    partials = spark.read.schema(schema).parquet(path)
    for regions, channels in CHOICES:
        want, got = dashboard(orders, products, users, regions, channels), dashboard_from(partials, regions, channels)
        for k in want:
            assert got[k].columns == want[k].columns
            assert sorted(map(str, rows(got[k]))) == sorted(map(str, rows(want[k]))), (k, regions, channels)


def test_one_scan_of_the_facts(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    tables = (fx.clean_orders(spark, SF_SMALL), fx.clean_products(spark, SF_SMALL), fx.clean_users(spark, SF_SMALL))
    path, plans, write = str(tmp_path / "p"), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, p, *a, **k: (plans.append(
        self._df._jdf.queryExecution().executedPlan().toString()), write(self, p, *a, **k))[1])
    build_partials(*tables, path)
    scans = [line for line in plans[0].splitlines() if "FileScan" in line]
    assert sum("lineitem.parquet" in s for s in scans) == 1 and plans[0].count("Expand") == 1
    for df in dashboard_from(spark.read.parquet(path), ["ASIA"]).values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "PartitionFilters: [isnotnull(_part" in plan
