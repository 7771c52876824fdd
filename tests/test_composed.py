"""The composed jobs agree with the operators they are built from."""

from funnelkit.functions.segments import segment_filter
from funnelkit.operators import dropoff, metrics
from funnelkit.plans.dashboard import dashboard, segment_values
from funnelkit.plans.insight import insight_tables
from funnelkit.sources import fixtures as fx
from tests.conftest import SF_SMALL, rows


def test_dashboard_views(spark):
    o, p, u = (fx.clean_orders(spark, SF_SMALL), fx.clean_products(spark, SF_SMALL),
               fx.clean_users(spark, SF_SMALL))
    regions = [r[1] for r in rows(segment_values(u)) if r[0] == "region"][:2]
    views = dashboard(o, p, u, regions=regions)
    assert set(views) == {"kpis", "weekly_revenue", "funnel", "dropoff"}
    kpi = views["kpis"].collect()[0]
    weekly = views["weekly_revenue"].collect()
    assert round(sum(r.revenue for r in weekly), 2) == round(kpi.total_revenue, 2)
    expect = metrics.kpi_totals(o, p, u, segment_filter(regions, [])).collect()[0]
    assert tuple(kpi) == tuple(expect)
    assert {r.region for r in views["dropoff"].collect()} <= set(regions)
    assert [r.step for r in views["funnel"].collect()][:4] == [1, 2, 3, 4]


def test_insight_tables(spark):
    o, u = fx.clean_orders(spark, SF_SMALL), fx.clean_users(spark, SF_SMALL)
    t = insight_tables(o, u)
    report = t["report"].collect()
    worst = t["worst"].collect()[0]
    assert (report[0]["Region"], report[0]["Channel"]) == (worst.region, worst.channel)
    md = dict(rows(t["markdown"]))
    d = dropoff.checkout_dropoff(o, u).collect()
    assert set(md) == {r.region for r in d}
    for region, text in md.items():
        lines = text.split("\n")
        assert lines[0].startswith("| Channel |") and lines[1].startswith("| --- |")
        assert len(lines) - 2 == sum(1 for r in d if r.region == region)
