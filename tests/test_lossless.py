"""CSV by header name, exact revenue, several date layouts, the complete cleaning job."""

import pytest

from funnelkit.operators import clean, metrics, quality
from funnelkit.plans.cleaning import run_cleaning
from funnelkit.sources import files, schemas


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_by_name_with_bad_text(spark, tmp_path):
    path = write(tmp_path / "o.csv", 'order_stage,extra,quantity,order_id,order_date,product_id,user_id\n'
                 'Purchased,x,3.0,1,2026-01-05 10:00:00,5,77\n'
                 '"a ""b"", c\nnext",y,abc,2,,nan,8\n')
    rows = {r.order_id: r for r in files.read_csv(spark, path, schemas.RAW_ORDERS, keep_bad=True).collect()}
    assert (rows[1].user_id, rows[1].product_id, rows[1].quantity) == (77, 5, 3) and rows[1]._bad is None
    assert rows[2].order_stage == 'a "b", c\nnext' and rows[2].quantity is None
    assert rows[2]._bad == {"quantity": "abc"} and rows[2].product_id is None
    with pytest.raises(ValueError, match="user_id"):
        files.read_csv(spark, write(tmp_path / "p.csv", "order_id\n1\n"), schemas.RAW_ORDERS)


def test_csv_text_survives_writing(spark, tmp_path):
    text = 'a "b", c\nd, \\"e\\"'
    df = spark.createDataFrame([(1, text, 1.5), (2, None, None)], schemas.RAW_PRODUCTS)
    files.write_table(df, str(tmp_path / "t"), "csv")
    back = files.read_csv(spark, str(tmp_path / "t"), schemas.RAW_PRODUCTS)
    assert sorted(map(tuple, back.collect())) == [(1, text, 1.5), (2, None, None)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_revenue_is_exact(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        products = spark.createDataFrame([(1, "a", 0.125), (2, "b", 1.0), (3, "c", float("nan")),
                                          (4, "d", 1e11)], schemas.RAW_PRODUCTS)
        users = spark.createDataFrame([(1, None, "R", "C")], schemas.CLEAN_USERS)

        def total(*lines):
            orders = spark.createDataFrame([(i, 1, p, q, "Purchased", None) for i, (p, q) in
                                            enumerate(lines)], schemas.CLEAN_ORDERS)
            return metrics.kpi_totals(orders, products, users).first()
        assert total((1, 1000), (2, 1)).total_revenue == 126.0
        assert total((2, 5), (3, 7)).total_revenue == 5.0
        assert total((4, 10_000_000)).total_revenue == 1e18
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_date_layouts(spark):
    df = spark.createDataFrame([("2026-01-01 09:00:00",), ("2026-01-05",), ("x",), (None,)], "d string")
    got = clean.parse_order_dates(df, "d", [schemas.TIMESTAMP_FORMAT, schemas.DATE_FORMAT]).collect()
    assert [str(r.d) for r in got] == ["2026-01-01 09:00:00", "2026-01-05 00:00:00", "None", "None"]


def test_null_keys_in_samples(spark):
    df = spark.createDataFrame([(None, -1, 1), (None, -2, 2), (3, -4, 3), (3, 5, 4)],
                               "order_id long, quantity long, n int")
    assert clean.dedup_audit(df, "order_id", ["n"]).first().sample_duplicate_ids == "[NULL, 3]"
    sample = clean.quantity_audit(df, "quantity", "order_id", ["n"]).first().negative_sample
    assert sample.count("order_id") == 3


def test_job_writes_every_report(spark, tmp_path):
    inputs = {
        "users": write(tmp_path / "u.csv", "user_id,region,channel,signup_date\n1,R,C,2026-01-01\n2,R,D,never\n"),
        "products": write(tmp_path / "p.csv", "product_id,product_name,base_price\n" + "".join(
            f"{i},n{i},{10 + i}\n" for i in range(1, 9)) + "9,n9,9000\n10,n10,cheap\n"),
        "orders": write(tmp_path / "o.csv", "order_id,user_id,product_id,quantity,order_stage,order_date\n"
                        "1,1,1,-2,Purchased,2026-01-05\n1,1,1,5,Visited,2026-01-05\n2,9,2,0,Visited,x\n"
                        "3,9,3,4,Odd,2026-01-05 10:00:00\n4,2,99,two,Visited,x\n")}
    out = run_cleaning(spark, inputs, str(tmp_path / "out"),
                       order_fmt=[schemas.TIMESTAMP_FORMAT, schemas.DATE_FORMAT])
    read = {k: spark.read.parquet(v) for k, v in out.items()}
    assert sorted(r.order_id for r in read["orders"].collect()) == [1, 3, 4]
    assert {r.order_id: r.quantity for r in read["orders"].collect()} == {1: 2, 3: 4, 4: None}
    issues = {(r.check_name, r.column_name): r.n_issues for r in read["validation"].collect()}
    assert issues["not_numeric", "orders.quantity"] == 1
    assert issues["not_numeric", "products.base_price"] == 1
    assert issues["unparseable_date", "orders.order_date"] == 1
    assert issues["unparseable_date", "users.signup_date"] == 1
    assert issues["orphan_key", "orders.user_id"] == 1
    assert issues["orphan_key", "orders.product_id"] == 1
    assert issues["unknown_stage", "orders.order_stage"] == 1
    assert issues["total_issues", "all"] == 7
    assert read["dedup_audit"].first().duplicates_found == 1
    assert read["quantity_audit"].first().negative_quantities == 1
    assert [r.product_id for r in read["price_corrections"].collect()] == [9]
    assert read["orders_profile"].first().total_orders == 3
    assert {r.order_stage: r.n_rows for r in read["stage_mix"].collect()}["Purchased"] == 1
    assert quality.validation_report is not None
