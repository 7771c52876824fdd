"""Checkout drop-off by region x channel.

A user who initiated checkout on any order counts as converted if they
purchased on any order. Plan: one pass over the orders of the two stages,
aggregated per user to two flags (map-side partial aggregation, so a hot user
is one row before the shuffle), then the user dimension joined on a key that
is unique on the order side, then the region x channel aggregate.
``distinct`` over (user, region, channel) keeps exact duplicate dimension rows
from counting twice, as SELECT DISTINCT does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions.text import pct_text
from funnelkit.sources.schemas import CHECKOUT, PURCHASED


def checkout_dropoff(orders: DataFrame, users: DataFrame,
                     segment: Column | None = None) -> DataFrame:
    """``(region, channel, checkout_initiated, purchased, dropped_off,
    dropoff_rate_pct)``.

    With a segment predicate both sides are restricted to users that pass it;
    as the purchase side only needs the user to pass, checking it on the
    checkout side's user row gives the same result.
    """
    stage = F.col("order_stage")
    flags = (orders.where(stage.isin(CHECKOUT, PURCHASED))
             .groupBy("user_id")
             .agg(F.max((stage == CHECKOUT).cast("int")).alias("_checkout"),
                  F.max((stage == PURCHASED).cast("int")).alias("_purchased"))
             .where(F.col("_checkout") == 1))
    dim = users.select("user_id", "region", "channel")
    if segment is not None:
        dim = dim.where(segment)
    per_user = flags.join(dim, "user_id").select(
        "user_id", "region", "channel", "_purchased").distinct()
    return dropoff_of(per_user)


def dropoff_of(per_user: DataFrame) -> DataFrame:
    """:func:`checkout_dropoff` of one row per user (with a checkout) and segment: ``_purchased``."""
    agg = per_user.groupBy("region", "channel").agg(
        F.count(F.lit(1)).alias("checkout_initiated"),
        F.sum("_purchased").cast("bigint").alias("purchased"))
    dropped = F.col("checkout_initiated") - F.col("purchased")
    rate = F.round(F.try_divide(dropped.cast("double") * F.lit(100.0),
                                F.col("checkout_initiated").cast("double")), 1)
    return agg.select("region", "channel", "checkout_initiated", "purchased",
                      dropped.alias("dropped_off"), rate.alias("dropoff_rate_pct"))


def _worst_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("dropoff_rate_pct"),
                      F.desc_nulls_last("dropped_off"),
                      F.asc_nulls_last("region"), F.asc_nulls_last("channel"))


def rank_dropoff(dropoff: DataFrame) -> DataFrame:
    """Add text rate and severity rank (RANK by rate, worst first)."""
    w = Window.orderBy(F.desc_nulls_last("dropoff_rate_pct"))
    out = dropoff.select(
        "region", "channel", "checkout_initiated", "purchased", "dropped_off",
        pct_text("dropoff_rate_pct").alias("dropoff_rate"),
        F.rank().over(w).cast("bigint").alias("severity_rank"),
        "dropoff_rate_pct")
    return _worst_first(out).drop("dropoff_rate_pct")


def dropoff_report(dropoff: DataFrame) -> DataFrame:
    """Drop-off rows under report headings, worst first."""
    return _worst_first(dropoff).select(
        F.col("region").alias("Region"),
        F.col("channel").alias("Channel"),
        F.col("checkout_initiated").alias("Checkouts"),
        F.col("purchased").alias("Purchased"),
        F.col("dropped_off").alias("Dropped Off"),
        F.col("dropoff_rate_pct").alias("Drop-off %"))


def worst_segment(dropoff: DataFrame) -> DataFrame:
    """The single worst segment (top-1 by rate, then dropped, region, channel)."""
    return _worst_first(dropoff).limit(1)


def dropoff_segment(orders: DataFrame, users: DataFrame,
                    segment: Column | None = None) -> DataFrame:
    """Drop-off for a segment, with the dashboard's column names."""
    return dashboard_rows(checkout_dropoff(orders, users, segment))


def dashboard_rows(dropoff: DataFrame) -> DataFrame:
    """Drop-off rows, worst first, with the dashboard's column names."""
    return _worst_first(dropoff).select(
        "region", "channel",
        F.col("checkout_initiated").alias("checkouts"), "purchased",
        "dropped_off", F.col("dropoff_rate_pct").alias("dropoff_pct"))
