"""Bucketed tables: same results, no exchange of the facts by the bucket key."""

import re

import pytest

from funnelkit.operators import dropoff, metrics, quality
from funnelkit.sources import fixtures as fx
from funnelkit.sources.buckets import bucketed_star, write_bucketed
from tests.conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    plain = {"users": fx.clean_users(spark, SF_SMALL), "products": fx.clean_products(spark, SF_SMALL),
             "orders": fx.clean_orders(spark, SF_SMALL)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = bucketed_star(spark, **plain, prefix="fk_test", buckets=4, path=path)
    yield plain, tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for name in tables:
        spark.sql(f"DROP TABLE fk_test_{name}")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"hashpartitioning\((\w+?)#", plan)


def test_dropoff_needs_no_exchange_by_user(spark, star):
    plain, t = star
    df = dropoff.checkout_dropoff(t["orders_by_user"], t["users"])
    assert sorted(rows(df)) == sorted(rows(dropoff.checkout_dropoff(plain["orders"], plain["users"])))
    assert set(exchanges(df)) == {"region"}    # aggregated segments only
    assert "user_id" in exchanges(dropoff.checkout_dropoff(plain["orders"], plain["users"]))


def test_revenue_needs_no_exchange_by_product(spark, star):
    plain, t = star
    df = metrics.weekly_kpis(t["orders_by_product"], t["products"])
    assert sorted(map(str, rows(df))) == sorted(map(str, rows(metrics.weekly_kpis(plain["orders"], plain["products"]))))
    assert "product_id" not in exchanges(df)


def test_empty_table_and_wrong_number(spark, tmp_path):
    empty = spark.createDataFrame([], "user_id long, region string")
    write_bucketed(empty, "fk_test_empty", "user_id", 3, str(tmp_path / "e"))
    assert spark.table("fk_test_empty").count() == 0
    spark.sql("DROP TABLE fk_test_empty")
    with pytest.raises(ValueError):
        write_bucketed(empty, "fk_test_bad", "user_id", 0)


def test_orphans_equal(spark, star):
    plain, t = star
    lost = t["users"].where("user_id % 5 <> 0")
    got = rows(quality.orphans(t["orders_by_user"], lost, "user_id"), "order_id", "user_id")
    want = rows(quality.orphans(plain["orders"], plain["users"].where("user_id % 5 <> 0"), "user_id"),
                "order_id", "user_id")
    assert sorted(got) == sorted(want)
