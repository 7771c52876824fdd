import random

from funnelkit.functions.segments import segment_filter
from funnelkit.operators import dropoff, funnel, report
from tests.conftest import rows

ORD = "order_id long, user_id long, order_stage string"
STAGES = ["Visited", "Added to Cart", "Checkout Initiated", "Purchased"]


def test_funnel_unknown_last_and_first_present_step_is_base(spark):
    orders = spark.createDataFrame([
        (1, 1, "Added to Cart"), (2, 1, "Added to Cart"), (3, 2, "Purchased"),
        (3, 2, "Purchased"), (4, 2, None), (5, 3, "Oops")], ORD)
    got = rows(funnel.funnel(orders))
    assert got[0] == (2, "Added to Cart", 2, "100.0%", "--", "--")
    assert got[1] == (4, "Purchased", 1, "50.0%", "50.0%", "1")
    assert [g[0] for g in got[2:]] == [None, None]
    assert {g[1] for g in got[2:]} == {None, "Oops"}


def _brute_dropoff(users, orders, regions=None):
    seg = {u: (r, c) for u, r, c in users if not regions or r in regions}
    checkout = {(u, *seg[u]) for _, u, s in orders if s == "Checkout Initiated" and u in seg}
    bought = {u for _, u, s in orders if s == "Purchased"}
    out = {}
    for u, r, c in checkout:
        n, p = out.get((r, c), (0, 0))
        out[(r, c)] = (n + 1, p + (u in bought))
    return {k: (n, p, n - p) for k, (n, p) in out.items()}


def test_dropoff_matches_brute_force(spark):
    rnd = random.Random(7)
    users = [(u, rnd.choice(["EU", "US", "ASIA"]), rnd.choice(["web", "ads"]))
             for u in range(60)]
    orders = [(i, rnd.randrange(70), rnd.choice(STAGES)) for i in range(400)]
    udf = spark.createDataFrame(users, "user_id long, region string, channel string")
    odf = spark.createDataFrame(orders, ORD)
    got = {(r.region, r.channel): (r.checkout_initiated, r.purchased, r.dropped_off)
           for r in dropoff.checkout_dropoff(odf, udf).collect()}
    assert got == _brute_dropoff(users, orders)
    seg = {(r.region, r.channel): (r.checkouts, r.purchased, r.dropped_off)
           for r in dropoff.dropoff_segment(odf, udf, segment_filter(["EU"], [])).collect()}
    assert seg == _brute_dropoff(users, orders, ["EU"])
    for r in dropoff.checkout_dropoff(odf, udf).collect():
        assert r.purchased + r.dropped_off == r.checkout_initiated


def test_rank_worst_and_markdown(spark):
    d = spark.createDataFrame([
        ("EU", "web", 4, 1, 3, 75.0), ("EU", "ads", 4, 3, 1, 25.0),
        ("US", "web", 8, 2, 6, 75.0)],
        "region string, channel string, checkout_initiated long, purchased long, "
        "dropped_off long, dropoff_rate_pct double")
    ranked = rows(dropoff.rank_dropoff(d), "region", "channel", "dropoff_rate", "severity_rank")
    assert ranked == [("US", "web", "75.0%", 1), ("EU", "web", "75.0%", 1),
                      ("EU", "ads", "25.0%", 3)]
    assert rows(dropoff.worst_segment(d), "region", "channel") == [("US", "web")]
    md = dict(rows(report.segment_report_text(d)))
    assert md["EU"] == ("| Channel | Checkouts | Purchased | Dropped Off | Drop-off % |\n"
                        "| --- | --- | --- | --- | --- |\n"
                        "| web | 4 | 1 | 3 | 75.0 |\n"
                        "| ads | 4 | 3 | 1 | 25.0 |")
    heads = dropoff.dropoff_report(d).columns
    assert heads == ["Region", "Channel", "Checkouts", "Purchased", "Dropped Off", "Drop-off %"]


def test_weekly_report_text(spark):
    g = spark.createDataFrame([(2024, 1, 1234567.5, 12.345, None, None),
                               (2024, 2, 10.0, 10.0, 1234567.5, -99.9)],
                              "year long, week_num long, total_revenue double, aov double, "
                              "prev_week_revenue double, wow_growth_pct double")
    g = g.selectExpr("*", "DATE'2024-01-01' AS week_start", "DATE'2024-01-07' AS week_end",
                     "1L AS total_orders")
    got = rows(report.weekly_report(g), "total_revenue", "prev_week_revenue", "wow_growth")
    assert got == [("$1,234,567.50", "$", "--"), ("$10.00", "$1,234,567.50", "-99.9%")]


def _sql_semantics(users, orders, regions=None):
    """checkout_users DISTINCT (user, region, channel) LEFT JOIN purchasers,
    both sides restricted by the segment as the dashboard query does."""
    ok = lambda r: not regions or r in regions
    checkout = {(u, r, c) for _, u, s in orders if s == "Checkout Initiated"
                for uu, r, c in users if uu == u and ok(r)}
    bought = {u for _, u, s in orders if s == "Purchased"
              for uu, r, _ in users if uu == u and ok(r)}
    out = {}
    for u, r, c in checkout:
        n, p = out.get((r, c), (0, 0))
        out[(r, c)] = (n + 1, p + (u in bought))
    return {k: (n, p, n - p) for k, (n, p) in out.items()}


def test_dropoff_with_duplicate_dimension_rows(spark):
    users = [(1, "EU", "web"), (1, "US", "web"), (2, "EU", "ads"), (2, "EU", "ads"),
             (3, "US", "ads")]
    orders = [(1, 1, "Checkout Initiated"), (2, 1, "Purchased"), (3, 2, "Checkout Initiated"),
              (4, 3, "Checkout Initiated"), (5, 3, "Purchased"), (6, 9, "Purchased")]
    udf = spark.createDataFrame(users, "user_id long, region string, channel string")
    odf = spark.createDataFrame(orders, ORD)
    got = {(r.region, r.channel): (r.checkout_initiated, r.purchased, r.dropped_off)
           for r in dropoff.checkout_dropoff(odf, udf).collect()}
    assert got == _sql_semantics(users, orders)
    seg = {(r.region, r.channel): (r.checkouts, r.purchased, r.dropped_off)
           for r in dropoff.dropoff_segment(odf, udf, segment_filter(["EU"], [])).collect()}
    assert seg == _sql_semantics(users, orders, ["EU"])


def test_percent_text_stays_positional(spark):
    from pyspark.sql import functions as F

    from funnelkit.functions.text import pct_text
    df = spark.createDataFrame([(12345678.9,), (21.8,), (None,), (100.0,)], "x double")
    assert [r[0] for r in df.select(pct_text(F.col("x"))).collect()] == \
        ["12345678.9%", "21.8%", "%", "100.0%"]
