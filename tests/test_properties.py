"""Random inputs against plain-Python references."""

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from funnelkit.operators import funnel, metrics

STAGES = ["Visited", "Added to Cart", "Checkout Initiated", "Purchased", "Lost", None]
ORD = "order_id long, user_id long, product_id long, quantity long, " \
      "order_stage string, order_date timestamp_ntz"

rows_st = st.lists(st.tuples(st.integers(1, 40), st.integers(1, 4), st.integers(1, 9),
                             st.sampled_from(STAGES), st.integers(0, 60)), max_size=60)
prices_st = st.lists(st.integers(1, 100000).map(lambda c: c / 100.0), min_size=4, max_size=4)


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_st, prices_st)
def test_weekly_kpis_and_growth_match_exact_reference(spark, data, prices):
    base = dt.datetime(2023, 12, 20, 8, 0, 0)
    orders = [(oid, 1, pid, q, s, base + dt.timedelta(days=d))
              for oid, pid, q, s, d in data]
    price = {i + 1: p for i, p in enumerate(prices)}
    odf = spark.createDataFrame(orders, ORD)
    pdf = spark.createDataFrame([(k, "p", v) for k, v in price.items()],
                                "product_id long, product_name string, base_price double")
    got = {(r.year, r.week_num): r for r in
           metrics.weekly_growth(metrics.weekly_kpis(odf, pdf)).collect()}

    cents, ids = defaultdict(int), defaultdict(set)
    for oid, _, pid, q, s, ts in orders:
        if s == "Purchased" and pid in price:
            key = (ts.year, ts.isocalendar()[1])
            cents[key] += q * int(Decimal(str(price[pid])) * 100)
            ids[key].add(oid)
    assert set(got) == set(cents)
    prev = None
    for key in sorted(cents):
        r = got[key]
        c, n = cents[key], len(ids[key])
        assert r.total_orders == n
        assert r.total_revenue == c / 100
        aov = (Decimal(c) / n).quantize(Decimal(1), rounding=ROUND_HALF_UP) / 100
        assert r.aov == float(aov)
        if prev is None:
            assert r.prev_week_revenue is None and r.wow_growth_pct is None
        else:
            assert r.prev_week_revenue == prev / 100
            if prev:
                exp = (c / 100 - prev / 100) / (prev / 100) * 100
                assert abs(r.wow_growth_pct - exp) <= 0.05 + 1e-9
        prev = c


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_st)
def test_funnel_counts_match_reference(spark, data):
    base = dt.datetime(2024, 1, 1)
    odf = spark.createDataFrame([(oid, 1, pid, q, s, base) for oid, pid, q, s, _ in data],
                                ORD)
    got = funnel.funnel(odf).collect()
    counts = defaultdict(set)
    for oid, _, _, s, _ in data:
        counts[s].add(oid)
    assert {r.funnel_stage: r.unique_events for r in got} == \
        {s: len(v) for s, v in counts.items()}
    steps = [r.step for r in got]
    known = [x for x in steps if x is not None]
    assert known == sorted(known) and steps[:len(known)] == known  # NULL steps last
    if got:
        first = got[0].unique_events
        for r in got:
            exp = round(r.unique_events * 100.0 / first + 1e-12, 1)
            assert abs(float(r.abs_conversion_pct[:-1]) - exp) <= 0.1
