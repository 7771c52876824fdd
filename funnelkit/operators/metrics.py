"""Revenue metrics: weekly KPIs, week-over-week growth, KPI totals.

Revenue is ``quantity x base_price`` of Purchased orders, summed exactly
(see ``functions.money``). The stage filter sits right above the scan, the
product (and user) joins follow, then one aggregate over two grouping sets: per
price the summed quantity, per order nothing but its existence. So one scan and
one shuffle give revenue and distinct orders, lines only add up whole numbers,
and a price is multiplied once per group. Windows without a partition key only
ever run over the aggregated weeks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions.money import (average_order_value, checked_sum, money, price_digits,
                                       price_product, total_amount)
from funnelkit.sources.schemas import PURCHASED


def purchased_lines(orders: DataFrame, products: DataFrame,
                    users: DataFrame | None = None,
                    segment: Column | None = None) -> DataFrame:
    """Purchased order rows joined to their product (and user) with the line amount.

    Inner joins: orders of unknown products (or users) leave, as in SQL.
    """
    lines = (orders.where(F.col("order_stage") == PURCHASED)
             .select("order_id", "user_id", "product_id", "quantity", "order_date"))
    joins = [(products.select("product_id", "base_price"), "product_id")]
    if users is not None:
        people = users.select("user_id", "region", "channel")
        if segment is None:
            joins.append((people, "user_id"))
        else:  # users first: rows outside the segment never reach the product join
            joins.insert(0, (people.where(segment), "user_id"))
    for side, key in joins:
        lines = lines.join(side, key)
    return lines


def revenue_by(lines: DataFrame, **keys: Column) -> DataFrame:
    """Per group of ``keys``: revenue, _amount, total_orders, week_start, week_end.

    ``lines`` come from :func:`purchased_lines`. ``_amount`` is the exact revenue,
    ``revenue`` the nearest double; both are NULL if no line has a quantity and a
    price. NaN prices are missing, an infinite price makes the revenue infinite.
    Without keys there is one row, also for no lines.
    """
    names = list(keys)
    day = F.to_date("order_date")
    sets = lines.select(*[c.alias(k) for k, c in keys.items()], "order_id", "base_price", "quantity",
                        day.alias("_day"))
    parts = sets.groupingSets([[*names, "base_price"], [*names, "order_id"]],
                              *names, "base_price", "order_id").agg(
        F.grouping_id().alias("_set"), checked_sum("quantity").alias("_q"),
        F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    by_price = F.col("_set") % 4 == 1      # the order was summed away, the price not
    return revenue_of(parts.select(
        *names, F.when(by_price, F.col("base_price")).alias("base_price"),
        F.when(by_price, F.col("_q")).alias("_q"),
        (~by_price & F.col("order_id").isNotNull()).alias("_order"), "_first", "_last"), *names)


def revenue_of(parts: DataFrame, *names: str) -> DataFrame:
    """:func:`revenue_by` from partial rows: a price with its summed quantity ``_q``, or an
    order (``_order``), each with the ``_first`` and ``_last`` day of its lines."""
    digits = price_digits("base_price")
    endless = F.abs("base_price") == float("inf")
    terms = parts.select(
        *names, digits["e"].alias("_e"), price_product("_q", digits).alias("_t"),
        F.when(endless, F.col("_q") * F.col("base_price")).alias("_endless"),
        "_order", "_first", "_last")
    by_power = terms.groupBy(*names, "_e").agg(
        F.sum("_t").cast("decimal(38,0)").alias("_t"), F.sum("_endless").alias("_endless"),
        F.count_if("_order").alias("_orders"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    out = by_power.groupBy(*names).agg(
        total_amount(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(
            F.col("_e").alias("e"), F.col("_t").alias("t"))))).alias("_amount"),
        F.sum("_endless").alias("_endless"),
        F.coalesce(F.sum("_orders"), F.lit(0).cast("bigint")).alias("total_orders"),
        F.min("_first").alias("week_start"), F.max("_last").alias("week_end"))
    return out.withColumn("revenue", F.coalesce("_endless", money("_amount"))).drop("_endless")


def week_keys(iso_year: bool = False) -> tuple[Column, Column]:
    ts = F.col("order_date")
    year = (F.expr("extract(YEAROFWEEK FROM order_date)") if iso_year
            else F.year(ts))
    return year.cast("bigint"), F.weekofyear(ts).cast("bigint")


def weekly_kpis(orders: DataFrame, products: DataFrame, iso_year: bool = False,
                users: DataFrame | None = None,
                segment: Column | None = None) -> DataFrame:
    """Per (year, ISO week): first / last order date, orders, revenue, AOV.

    ``year`` is the calendar year by default, so a boundary week can merge
    with a week of the same number at the other end of the year (the source
    application's grouping); ``iso_year=True`` groups by ISO week-year.
    """
    lines = purchased_lines(orders, products, users, segment)
    year, week = week_keys(iso_year)
    agg = revenue_by(lines, year=year, week_num=week)
    whole = F.abs("revenue") < float("inf")
    return agg.select(
        "year", "week_num", "week_start", "week_end", "total_orders",
        F.col("revenue").alias("total_revenue"),
        F.when(whole, average_order_value("_amount", "total_orders"))
        .otherwise(F.try_divide("revenue", F.col("total_orders").cast("double"))).alias("aov"))


def weekly_growth(kpis: DataFrame) -> DataFrame:
    """Add previous present week's revenue and growth % (ROUND 1).

    Growth is NULL for the first week and when the previous revenue is 0.
    """
    w = Window.orderBy(F.asc_nulls_last("year"), F.asc_nulls_last("week_num"))
    prev = F.lag("total_revenue").over(w)
    out = kpis.withColumn("prev_week_revenue", prev)
    growth = F.try_divide(F.col("total_revenue") - F.col("prev_week_revenue"),
                          F.col("prev_week_revenue")) * F.lit(100.0)
    return out.withColumn("wow_growth_pct", F.round(growth, 1))


def kpi_totals(orders: DataFrame, products: DataFrame, users: DataFrame,
               segment: Column | None = None) -> DataFrame:
    """One row even on empty input: total revenue, AOV, distinct orders.

    Zero instead of NULL when nothing matches; AOV is not rounded.
    """
    lines = purchased_lines(orders, products, users, segment)
    agg = revenue_by(lines)
    revenue = F.coalesce("revenue", F.lit(0.0))
    return agg.select(
        revenue.alias("total_revenue"),
        F.coalesce(F.try_divide(revenue, F.col("total_orders").cast("double")),
                   F.lit(0.0)).alias("aov"),
        "total_orders")


def weekly_revenue(orders: DataFrame, products: DataFrame, users: DataFrame,
                   segment: Column | None = None) -> DataFrame:
    """Per (year, week): first order date, revenue and a text label."""
    lines = purchased_lines(orders, products, users, segment)
    year, week = week_keys(False)
    agg = revenue_by(lines, year=year, week_num=week)
    return agg.select("year", "week_num", "week_start", "revenue",
                      F.col("week_start").cast("string").alias("week_label"))
