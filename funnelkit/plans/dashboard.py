"""The dashboard's queries for one choice of segments, as DataFrames.

``dashboard`` plans the four widgets on the cleaned tables, each with its own scan.
``build_partials`` scans the facts once for all of them and stores what they are
made of; ``dashboard_from`` answers any choice of segments from that alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.money import checked_sum
from funnelkit.functions.segments import segment_filter
from funnelkit.operators.dropoff import dashboard_rows, dropoff_of, dropoff_segment
from funnelkit.operators.funnel import counts_of, funnel_segment, with_share
from funnelkit.operators.metrics import kpi_totals, revenue_of, week_keys, weekly_revenue
from funnelkit.sources.schemas import CHECKOUT, PURCHASED


def segment_values(users: DataFrame) -> DataFrame:
    """``(segment, value)``: the sorted distinct regions and channels."""
    regions = users.select(F.lit("region").alias("segment"),
                           F.col("region").alias("value")).distinct()
    channels = users.select(F.lit("channel").alias("segment"),
                            F.col("channel").alias("value")).distinct()
    return regions.unionByName(channels).orderBy("segment", "value")


def dashboard(orders: DataFrame, products: DataFrame, users: DataFrame,
              regions: Iterable[str] | None = None,
              channels: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """KPI cards, weekly revenue, funnel and drop-off for a segment choice."""
    seg = segment_filter(regions, channels)
    return {
        "kpis": kpi_totals(orders, products, users, seg),
        "weekly_revenue": weekly_revenue(orders, products, users, seg)
        .orderBy("year", "week_num"),
        "funnel": funnel_segment(orders, users, seg),
        "dropoff": dropoff_segment(orders, users, seg),
    }


def build_partials(orders: DataFrame, products: DataFrame, users: DataFrame, path: str) -> None:
    """Store the widgets' partial aggregates as Parquet, in one scan and one shuffle of the orders.

    Three grouping sets under region and channel: per week and price the sold
    quantity, per stage the orders (their ids, so that distinct counts stay exact
    for any choice of segments), per user whether they began a checkout and bought.
    They lie in one folder each.
    """
    known = products.select("product_id", "base_price", F.lit(True).alias("_known"))
    lines = (orders.join(users.select("user_id", "region", "channel"), "user_id")
             .join(known, "product_id", "left"))
    stage = F.col("order_stage")
    sold = (stage == PURCHASED) & F.col("_known")
    sold = F.coalesce(sold, F.lit(False))
    year, week = week_keys()
    rows = lines.select(
        "region", "channel", "user_id", "order_id", "order_stage",
        *[F.when(sold, c).alias(n) for n, c in (("year", year), ("week_num", week),
                                                ("base_price", F.col("base_price")),
                                                ("_q", F.col("quantity")),
                                                ("_day", F.to_date("order_date")))],
        sold.alias("_sold"), F.coalesce(stage == CHECKOUT, F.lit(False)).alias("_began"),
        F.coalesce(stage == PURCHASED, F.lit(False)).alias("_bought"))
    segment = ["region", "channel"]
    sets = {"price": ["year", "week_num", "base_price"], "order": ["order_stage", "order_id"],
            "user": ["user_id"]}
    every = [*segment, *sum(sets.values(), [])]
    parts = rows.groupingSets([segment + s for s in sets.values()], *every).agg(
        F.grouping_id().alias("_id"), checked_sum("_q").alias("_q"), F.min("_day").alias("_first"),
        F.max("_day").alias("_last"), F.max("_sold").alias("_sold"), F.max("_began").alias("_began"),
        F.max("_bought").alias("_bought"))
    name = None
    for label, columns in sets.items():
        gone = sum(2 ** (len(every) - 1 - i) for i, c in enumerate(every) if c not in segment + columns)
        name = (F.when(F.col("_id") == gone, label) if name is None
                else name.when(F.col("_id") == gone, label))
    useful = F.col("_part") != "price"
    (parts.withColumn("_part", name).drop("_id").where(useful | F.col("_sold"))
     .write.mode("overwrite").partitionBy("_part").parquet(path))


def dashboard_from(partials: DataFrame, regions: Iterable[str] | None = None,
                   channels: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The widgets of :func:`dashboard` from what ``build_partials`` stored."""
    chosen = partials.where(segment_filter(regions, channels))
    prices = chosen.where("_part = 'price'").withColumn("_order", F.lit(False))
    bought = (chosen.where("_part = 'order' AND _sold AND order_id IS NOT NULL")
              .agg(F.count_distinct("order_id").alias("total_orders")))
    revenue = F.coalesce("revenue", F.lit(0.0))
    kpis = revenue_of(prices).drop("total_orders").crossJoin(bought).select(
        revenue.alias("total_revenue"),
        F.coalesce(F.try_divide(revenue, F.col("total_orders").cast("double")), F.lit(0.0)).alias("aov"),
        "total_orders")
    weeks = revenue_of(prices, "year", "week_num").select(
        "year", "week_num", "week_start", "revenue", F.col("week_start").cast("string").alias("week_label"))
    people = chosen.where("_part = 'user' AND _began AND user_id IS NOT NULL").select(
        "region", "channel", F.col("_bought").cast("int").alias("_purchased"))
    return {"kpis": kpis, "weekly_revenue": weeks.orderBy("year", "week_num"),
            "funnel": with_share(counts_of(chosen.where("_part = 'order'"))),
            "dropoff": dashboard_rows(dropoff_of(people))}
