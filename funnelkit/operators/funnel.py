"""Conversion funnel: distinct orders per stage and step-to-step conversion.

Orders are counted by the stage they are in (one stage per order), so a later
step can exceed an earlier one. Unknown stages form rows with a NULL step that
sort last. The count is a two-level distinct aggregate; the windows run on the
handful of stage rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions.stages import stage_order
from funnelkit.functions.text import pct_text


def stage_counts(orders: DataFrame, users: DataFrame | None = None,
                 segment: Column | None = None) -> DataFrame:
    """``(order_stage, unique_events, stage_order)``."""
    df = orders.select("order_id", "user_id", "order_stage")
    if users is not None:
        df = df.join(users.select("user_id", "region", "channel"), "user_id")
        if segment is not None:
            df = df.where(segment)
    return counts_of(df)


def counts_of(rows: DataFrame) -> DataFrame:
    """:func:`stage_counts` of any rows with order_id and order_stage."""
    return (rows.groupBy("order_stage")
            .agg(F.count_distinct("order_id").alias("unique_events"))
            .withColumn("stage_order", stage_order("order_stage")))


def _ordered() -> Window:
    return Window.orderBy(F.asc_nulls_last("stage_order"), F.asc_nulls_last("order_stage"))


def funnel(orders: DataFrame) -> DataFrame:
    """Step, stage, distinct orders, % of first present step, step %, drop-off."""
    w = _ordered()
    counts = stage_counts(orders)
    n = F.col("unique_events")
    first = F.first_value(n).over(w)
    prev = F.lag(n).over(w)
    df = counts.select("stage_order", "order_stage", "unique_events",
                       first.alias("_first"), prev.alias("_prev"))
    abs_pct = F.round(F.try_divide(n.cast("double") * F.lit(100.0),
                                   F.col("_first").cast("double")), 1)
    step_pct = F.round(F.try_divide(n.cast("double") * F.lit(100.0),
                                    F.col("_prev").cast("double")), 1)
    no_prev = F.col("_prev").isNull()
    return df.select(
        F.col("stage_order").alias("step"),
        F.col("order_stage").alias("funnel_stage"),
        "unique_events",
        pct_text(abs_pct).alias("abs_conversion_pct"),
        F.when(no_prev, F.lit("--")).otherwise(pct_text(step_pct))
        .alias("step_conversion_pct"),
        F.when(no_prev, F.lit("--"))
        .otherwise((F.col("_prev") - n).cast("string")).alias("drop_off_count"),
    ).orderBy(F.asc_nulls_last("step"), "funnel_stage")


def funnel_segment(orders: DataFrame, users: DataFrame,
                   segment: Column | None = None) -> DataFrame:
    """Funnel counts for a segment (orders of unknown users leave) + share %."""
    return with_share(stage_counts(orders, users, segment))


def with_share(counts: DataFrame) -> DataFrame:
    """Stage counts in order, each with its share of the first one present."""
    w = _ordered()
    first = F.first_value("unique_events").over(w)
    share = F.try_divide(F.col("unique_events").cast("double") * F.lit(100.0),
                         first.cast("double"))
    return counts.select(F.col("stage_order").alias("step"),
                         F.col("order_stage").alias("funnel_stage"),
                         "unique_events", share.alias("pct_of_first")) \
        .orderBy(F.asc_nulls_last("step"), "funnel_stage")
