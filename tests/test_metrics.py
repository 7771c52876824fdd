import datetime as dt

from funnelkit.functions.segments import segment_filter
from funnelkit.operators import metrics
from tests.conftest import rows

ORD = "order_id long, user_id long, product_id long, quantity long, " \
      "order_stage string, order_date timestamp_ntz"


def ts(s):
    return dt.datetime.fromisoformat(s)


def _data(spark):
    products = spark.createDataFrame([(1, "a", 100.01), (2, "b", 0.5), (3, "c", 10.0)],
                                     "product_id long, product_name string, base_price double")
    users = spark.createDataFrame([(7, "EU", "web"), (8, "O'Brien land", "ads"),
                                   (9, None, "web")],
                                  "user_id long, region string, channel string")
    orders = spark.createDataFrame([
        (1, 7, 1, 1, "Purchased", ts("2024-12-30 10:00:00")),   # ISO week 1 of 2025
        (2, 8, 1, 1, "Purchased", ts("2024-01-03 10:00:00")),   # week 1 of 2024
        (2, 8, 2, 2, "Purchased", ts("2024-01-03 10:00:00")),
        (3, 9, 3, 1, "Purchased", ts("2024-01-10 10:00:00")),
        (4, 7, 3, 5, "Visited", ts("2024-01-10 10:00:00")),
        (5, 7, 99, 5, "Purchased", ts("2024-01-10 10:00:00")),  # unknown product
    ], ORD)
    return orders, products, users


def test_weekly_kpis_calendar_year_merges_boundary_week(spark):
    o, p, _ = _data(spark)
    got = {(r.year, r.week_num): r for r in metrics.weekly_kpis(o, p).collect()}
    w1 = got[(2024, 1)]
    # 2024-01-03 and 2024-12-30 share (calendar year 2024, ISO week 1)
    assert (w1.week_start, w1.week_end) == (dt.date(2024, 1, 3), dt.date(2024, 12, 30))
    assert w1.total_orders == 2
    assert w1.total_revenue == 201.02
    assert w1.aov == 100.51
    iso = {(r.year, r.week_num) for r in metrics.weekly_kpis(o, p, iso_year=True).collect()}
    assert (2025, 1) in iso and (2024, 1) in iso


def test_aov_rounds_half_up_exactly(spark):
    products = spark.createDataFrame([(1, "a", 100.01)],
                                     "product_id long, product_name string, base_price double")
    orders = spark.createDataFrame([(1, 1, 1, 1, "Purchased", ts("2024-01-03 00:00:00")),
                                    (2, 1, 1, 0, "Purchased", ts("2024-01-03 00:00:00"))], ORD)
    r = metrics.weekly_kpis(orders, products).collect()[0]
    assert r.total_revenue == 100.01 and r.aov == 50.01  # 50.005 -> 50.01


def test_growth_first_null_and_zero_previous(spark):
    kpis = spark.createDataFrame([(2024, 1, 0.0), (2024, 2, 50.0), (2024, 4, 75.0)],
                                 "year long, week_num long, total_revenue double")
    got = rows(metrics.weekly_growth(kpis).orderBy("week_num"),
               "week_num", "prev_week_revenue", "wow_growth_pct")
    assert got == [(1, None, None), (2, 0.0, None), (4, 50.0, 50.0)]


def test_kpi_totals_empty_segment_is_zero_row(spark):
    o, p, u = _data(spark)
    r = rows(metrics.kpi_totals(o, p, u, segment_filter(["NOWHERE"], [])))
    assert r == [(0.0, 0.0, 0)]


def test_kpi_totals_segments_add_up(spark):
    o, p, u = _data(spark)
    all_ = metrics.kpi_totals(o, p, u).collect()[0]
    parts = [metrics.kpi_totals(o, p, u, segment_filter([reg], [])).collect()[0]
             for reg in ["EU", "O'Brien land"]]
    nulls = metrics.kpi_totals(o, p, u, segment_filter([], ["web"])).collect()[0]
    assert parts[1].total_revenue == 101.01  # a quote in the value needs no escaping
    # the NULL region is only reachable without a region list
    assert round(sum(x.total_revenue for x in parts) + 10.0, 2) == all_.total_revenue
    assert nulls.total_orders == 2
    assert all_.total_orders == sum(x.total_orders for x in parts) + 1


def test_weekly_revenue_label(spark):
    o, p, u = _data(spark)
    got = rows(metrics.weekly_revenue(o, p, u, segment_filter([], ["ads"])),
               "week_label", "revenue")
    assert got == [("2024-01-03", 101.01)]


def _revenue(spark, lines):
    """(revenue, aov of one order) of (quantity, price) lines."""
    products = spark.createDataFrame([(i, "p", p) for i, (_, p) in enumerate(lines)],
                                     "product_id long, product_name string, base_price double")
    orders = spark.createDataFrame([(1, 7, i, q, "Purchased", ts("2024-01-03 10:00:00"))
                                    for i, (q, _) in enumerate(lines)], ORD)
    r = metrics.weekly_kpis(orders, products).collect()[0]
    return r.total_revenue, r.aov


def test_revenue_of_any_finite_price(spark):
    from fractions import Fraction
    inf = float("inf")
    cases = [[(10**9, 4e-7)], [(3, 1e13)], [(3, 0.1)], [(1, 1e13), (10**9, 4e-7), (7, 0.07)],
             [(2, 1e300)], [(5, 5e-324)], [(1, 1e300), (1, 1e-300)], [(1, 1e16), (1, 0.5), (-1, 1e16)],
             [(1, 123456789.12345678), (10**12, 0.30000000000000004)], [(1, -2.5), (1, 0.0)],
             [(2**40, 1.7976931348623157e308 / 2**41)], [(1, 0.005)], [(1, 1.005), (None, 3.0), (2, None)]]
    for lines in cases:
        exact = sum(q * Fraction(repr(p)) for q, p in lines if q is not None and p is not None)
        got, aov = _revenue(spark, lines)
        assert got == float(exact), lines
        cents = abs(exact) * 100
        half = (2 * cents.numerator + cents.denominator) // (2 * cents.denominator)
        if abs(exact) < 10**15:
            assert aov == (half if exact >= 0 else -half) / 100, lines
    assert _revenue(spark, [(10**9, 4e-7)])[0] == 400.0
    assert _revenue(spark, [(1, inf), (1, 1.0)]) == (inf, inf)
    assert _revenue(spark, [(1, float("nan")), (None, 1.0)]) == (None, None)


def test_quantity_sums_never_wrap_around(spark):
    import pytest
    with pytest.raises(Exception, match="bigint|overflow|OVERFLOW"):
        _revenue(spark, [(2**62, 1.0), (2**62, 1.0), (2**62, 1.0)])


def test_one_scan_and_one_shuffle_of_lines(spark):
    o, p, _ = _data(spark)
    plan = metrics.weekly_kpis(o, p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and "decimal" not in plan.split("Expand")[1]
