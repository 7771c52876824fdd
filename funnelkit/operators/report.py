"""Formatted reports: weekly report text, money columns, Markdown per group.

Everything is a Column expression over already aggregated rows. The Markdown
operator builds one table per group key inside an aggregate; each group is a
handful of aggregated rows (segments of one region), never a fact table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.text import (cell_text, currency_text, integer_text,
                                      markdown_row, pct_text)
from funnelkit.operators.metrics import purchased_lines, revenue_by


def weekly_report(growth: DataFrame) -> DataFrame:
    """Weekly KPIs as display text: ``$1,234.50``, ``12.3%``, ``--`` first."""
    first = F.col("prev_week_revenue").isNull()
    out = growth.select(
        "year",
        F.col("week_num").alias("week"),
        "week_start", "week_end", "total_orders",
        currency_text("total_revenue").alias("total_revenue"),
        currency_text("aov").alias("avg_order_value"),
        currency_text("prev_week_revenue").alias("prev_week_revenue"),
        F.when(first, F.lit("--")).otherwise(pct_text("wow_growth_pct"))
        .alias("wow_growth"))
    return out.orderBy(F.asc_nulls_last("year"), F.asc_nulls_last("week")) \
        .drop("year")


def region_currency(orders: DataFrame, products: DataFrame,
                    users: DataFrame) -> DataFrame:
    """Revenue, orders and AOV per region as display text (KPI-card style)."""
    lines = purchased_lines(orders, products, users)
    agg = revenue_by(lines, region=F.col("region"))
    revenue = F.col("revenue")
    aov = F.try_divide(revenue, F.col("total_orders").cast("double"))
    return agg.select(
        "region",
        currency_text(revenue).alias("revenue_text"),
        integer_text("total_orders").alias("orders_text"),
        currency_text(aov).alias("aov_text"))


def markdown_by_group(df: DataFrame, group: str, columns: Sequence[str],
                      order_by: Sequence[Column],
                      headings: Sequence[str] | None = None,
                      numeric: Sequence[str] = ()) -> DataFrame:
    """``(group, report)``: one Markdown table per group value.

    Rows appear in ``order_by`` order; ``headings`` default to column names.
    """
    headings = list(headings or columns)
    header = "| " + " | ".join(headings) + " |"
    rule = "| " + " | ".join(["---"] * len(headings)) + " |"
    cells = [cell_text(c, numeric=c in set(numeric)) for c in columns]
    keyed = df.select(
        group,
        F.struct(*[o.alias(f"_k{i}") for i, o in enumerate(order_by)]).alias("_k"),
        markdown_row(*cells).alias("_line"))
    agg = keyed.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("_k", "_line"))).alias("_rows"))
    body = F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n")
    return agg.select(group, F.concat(F.lit(header + "\n" + rule + "\n"), body)
                      .alias("report"))


def segment_report_text(dropoff: DataFrame) -> DataFrame:
    """Per region, the Markdown table of its channels' drop-off, worst first."""
    ranked = dropoff.select(
        "region", "channel", "checkout_initiated", "purchased", "dropped_off",
        "dropoff_rate_pct",
        (-F.col("dropoff_rate_pct")).alias("_neg_rate"),
        (-F.col("dropped_off")).alias("_neg_dropped"))
    return markdown_by_group(
        ranked, "region",
        ["channel", "checkout_initiated", "purchased", "dropped_off",
         "dropoff_rate_pct"],
        order_by=[F.col("_neg_rate"), F.col("_neg_dropped"), F.col("channel")],
        headings=["Channel", "Checkouts", "Purchased", "Dropped Off",
                  "Drop-off %"],
        numeric=["checkout_initiated", "purchased", "dropped_off",
                 "dropoff_rate_pct"])
