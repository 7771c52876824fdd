from pyspark.sql import functions as F

from funnelkit.operators import quality
from funnelkit.sources import files
from tests.conftest import rows

ORD = "order_id long, user_id long, product_id long, quantity long, " \
      "order_stage string, order_date string"


def _tables(spark):
    users = spark.createDataFrame(
        [(1, "2024-01-01", "EU", "web"), (2, "bad", "US", "ads"), (None, None, "EU", "web")],
        "user_id long, signup_date string, region string, channel string")
    products = spark.createDataFrame([(10, "a", 1.0), (11, "b", float("nan"))],
                                     "product_id long, product_name string, base_price double")
    orders = spark.createDataFrame([
        (1, 1, 10, 2, "Visited", "2024-01-01 10:00:00"),
        (2, 3, 10, 1, "Purchased", "2024-01-02 10:00:00"),
        (3, None, 12, 1, "Refunded", "oops"),
        (4, 2, None, None, None, "2024-01-03 10:00:00"),
        (5, 2, 11, 1, "Refunded", "2024-01-04 10:00:00"),
    ], ORD)
    return users, products, orders


def test_orphans_keep_null_keys(spark):
    users, products, orders = _tables(spark)
    assert sorted(r[0] for r in rows(quality.orphans(orders, users, "user_id"), "order_id")) == [2, 3]
    assert sorted(r[0] for r in rows(quality.orphans(orders, products, "product_id"), "order_id")) == [3, 4]


def test_unknown_stages_include_null(spark):
    _, _, orders = _tables(spark)
    got = sorted(rows(quality.unknown_stages(orders)), key=lambda r: str(r[0]))
    assert got == [(None,), ("Refunded",)]


def test_validation_report_totals(spark):
    users, products, orders = _tables(spark)
    rep = {(r.check_name, r.column_name): (r.n_issues, r.counted)
           for r in quality.validation_report(users, products, orders).collect()}
    assert rep[("unparseable_date", "users.signup_date")] == (2, True)
    assert rep[("unparseable_date", "orders.order_date")] == (1, True)
    assert rep[("null_values", "users.user_id")] == (1, False)
    assert rep[("null_values", "products.base_price")] == (1, False)
    assert rep[("null_values", "orders.quantity")] == (1, False)
    assert rep[("orphan_key", "orders.user_id")] == (2, True)
    assert rep[("orphan_key", "orders.product_id")] == (2, True)
    assert rep[("unknown_stage", "orders.order_stage")] == (2, True)
    assert rep[("not_numeric", "orders.quantity")] == (0, True)
    assert rep[("total_issues", "all")] == (2 + 1 + 2 + 2 + 2, True)


def test_validation_flags_non_numeric_column(spark):
    users, products, orders = _tables(spark)
    text_q = orders.withColumn("quantity", F.col("quantity").cast("string"))
    rep = {(r.check_name, r.column_name): r.n_issues
           for r in quality.validation_report(users, products, text_q).collect()}
    assert rep[("not_numeric", "orders.quantity")] == 0  # numeric text only
    dirty = text_q.withColumn("quantity", F.when(F.col("order_id") == 5, "lots")
                              .otherwise(F.col("quantity")))
    rep = {(r.check_name, r.column_name): r.n_issues
           for r in quality.validation_report(users, products, dirty).collect()}
    assert rep[("not_numeric", "orders.quantity")] == 1
    assert rep[("total_issues", "all")] == 2 + 1 + 2 + 2 + 2 + 1


def test_stage_mix_absent_stage_zero_and_base_all_rows(spark):
    _, _, orders = _tables(spark)
    got = rows(quality.stage_mix(orders).orderBy("step"))
    assert [(s, n) for _, s, n, _ in got] == [
        ("Visited", 1), ("Added to Cart", 0), ("Checkout Initiated", 0), ("Purchased", 1)]
    assert got[0][3] == 20.0


def test_orders_profile(spark):
    _, _, orders = _tables(spark)
    r = quality.orders_profile(orders).collect()[0]
    assert (r.total_orders, r.unique_users, r.unique_products) == (5, 3, 3)


def test_table_counts_and_csv_round_trip(spark, tmp_path):
    users, products, orders = _tables(spark)
    got = dict(rows(files.table_counts(users=users, orders=orders)))
    assert got == {"users": 3, "orders": 5}
    path = str(tmp_path / "orders_csv")
    files.write_table(orders, path, "csv")
    from funnelkit.sources.schemas import RAW_ORDERS
    back = files.read_csv(spark, path, RAW_ORDERS)
    assert sorted(rows(back, *orders.columns), key=lambda r: r[0]) == \
        sorted(rows(orders), key=lambda r: r[0])


def test_read_tables_lists_every_missing_path(spark, tmp_path):
    import pytest
    paths = {t: str(tmp_path / t) for t in ("users", "products", "orders")}
    with pytest.raises(FileNotFoundError) as e:
        files.read_tables(spark, paths)
    assert all(p in str(e.value) for p in paths.values())


def _issues(df):
    return {(r.check_name, r.column_name): r.n_issues for r in df.collect()}


def test_one_pass_counts_orphans_of_any_key(spark):
    """Negative, 64-bit, NULL, hot and repeated keys, against plain set membership."""
    import random
    rng = random.Random(3)
    wide = [None, 0, -1, 1, 32767, 32768, -32768, -32769, 2**63 - 1, -2**63, 2**40, -2**40, 77]
    users = [(k, "2024-01-01", "EU", "web") for k in wide[:9] + [0, None]]
    products = [(k, "p", 1.0) for k in wide[3:] + [5, 5]]
    orders = [(i, rng.choice([77] * 9 + wide), rng.choice([5] * 9 + wide), 1,
               rng.choice(["Visited", "Refunded", None, "Lost"]), "2024-01-01 10:00:00") for i in range(600)]
    u = spark.createDataFrame(users, "user_id long, signup_date string, region string, channel string")
    p = spark.createDataFrame(products, "product_id long, product_name string, base_price double")
    o = spark.createDataFrame(orders, ORD).repartition(5)
    got = _issues(quality.validation_report(u, p, o))
    known_u, known_p = {r[0] for r in users} - {None}, {r[0] for r in products} - {None}
    assert got["orphan_key", "orders.user_id"] == sum(r[1] not in known_u for r in orders)
    assert got["orphan_key", "orders.product_id"] == sum(r[2] not in known_p for r in orders)
    assert got["unknown_stage", "orders.order_stage"] == 3
    assert got["null_values", "orders.user_id"] == sum(r[1] is None for r in orders)
    assert got["null_values", "users.user_id"] == 2 and got["null_values", "products.product_id"] == 0
    checked = quality.check_pass(u, p, o).first()
    assert checked.unique_users == len({r[1] for r in orders} - {None})
    assert checked.unique_products == len({r[2] for r in orders} - {None})
    assert quality.orphans(o, u, "user_id").count() == got["orphan_key", "orders.user_id"]


def test_validation_reads_each_table_once(spark):
    from funnelkit.plans.registry import validation_report
    plan = validation_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("lineitem.parquet" in s for s in scans) == 1
    assert sum("customer.parquet" in s for s in scans) == 1
    assert sum("part.parquet" in s for s in scans) == 1


def test_validation_of_empty_tables(spark):
    users, products, orders = (df.limit(0) for df in _tables(spark))
    assert set(_issues(quality.validation_report(users, products, orders)).values()) == {0}
