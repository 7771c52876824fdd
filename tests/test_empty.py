"""Every operator on empty inputs: no error, zero counts, no NULL totals."""

from funnelkit.operators import clean, dropoff, funnel, metrics, quality, report

ORD = "order_id long, user_id long, product_id long, quantity long, " \
      "order_stage string, order_date string, pos long"


def _empty(spark):
    orders = spark.createDataFrame([], ORD)
    users = spark.createDataFrame([], "user_id long, signup_date string, region string, "
                                      "channel string")
    products = spark.createDataFrame([], "product_id long, product_name string, "
                                         "base_price double")
    return orders, users, products


def test_cleaning_operators_on_empty_input(spark):
    o, u, p = _empty(spark)
    a = clean.dedup_audit(o, "order_id", ["pos"]).collect()[0]
    assert (a.rows_before, a.duplicates_found, a.rows_after, a.sample_duplicate_ids) == \
        (0, 0, 0, "[]")
    q = clean.quantity_audit(o, "quantity", "order_id", ["pos"]).collect()[0]
    assert (q.negative_quantities, q.zero_quantities, q.total_affected) == (0, 0, 0)
    assert clean.deduplicate(o, "order_id", ["pos"]).count() == 0
    assert clean.cap_price_outliers(p).count() == 0
    assert clean.price_correction_log(p).count() == 0
    r = clean.replacement_price(p).collect()[0]
    assert r.n_outliers == 0 and r.replacement_price is None


def test_quality_operators_on_empty_input(spark):
    o, u, p = _empty(spark)
    rep = {(r.check_name, r.column_name): r.n_issues
           for r in quality.validation_report(u, p, o).collect()}
    assert rep[("total_issues", "all")] == 0
    assert all(v == 0 for v in rep.values())
    prof = quality.orders_profile(o).collect()[0]
    assert (prof.total_orders, prof.unique_users, prof.unique_products) == (0, 0, 0)
    mix = quality.stage_mix(o).collect()
    assert [r.n_rows for r in mix] == [0, 0, 0, 0]
    assert quality.unknown_stages(o).count() == 0


def test_analytics_on_empty_input(spark):
    o, u, p = _empty(spark)
    o = o.withColumn("order_date", o.order_date.cast("timestamp_ntz"))
    assert metrics.weekly_kpis(o, p).count() == 0
    assert metrics.weekly_growth(metrics.weekly_kpis(o, p)).count() == 0
    assert tuple(metrics.kpi_totals(o, p, u).collect()[0]) == (0.0, 0.0, 0)
    assert funnel.funnel(o).count() == 0
    d = dropoff.checkout_dropoff(o, u)
    assert d.count() == 0 and dropoff.worst_segment(d).count() == 0
    assert report.segment_report_text(d).count() == 0
