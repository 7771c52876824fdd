"""One callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Inputs are the views of ``sources.fixtures`` over the test tables, so each
query's work grows with the tables. Raw views carry ``ord1..ord4``, which with
``order_id`` give the arrival order used by keep-first deduplication.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.functions.segments import segment_filter
from funnelkit.operators import clean, dropoff, funnel, metrics, quality, report
from funnelkit.plans.cleaning import clean_orders as clean_orders_plan
from funnelkit.plans.dashboard import segment_values as segment_values_plan
from funnelkit.session import scratch_path
from funnelkit.sources import files
from funnelkit.sources import fixtures as fx
from funnelkit.sources.schemas import CLEAN_ORDERS

Query = Callable[[SparkSession, str], DataFrame]

ARRIVAL = fx.ARRIVAL
# Segment choices exercised by the filtered dashboard queries.
KPI_REGIONS = ["ASIA", "EUROPE"]
TREND_CHANNELS = ["AUTOMOBILE", "BUILDING"]
FUNNEL_REGIONS = ["AMERICA"]
FUNNEL_CHANNELS = ["MACHINERY", "HOUSEHOLD"]
DROPOFF_REGIONS = ["EUROPE", "AFRICA", "MIDDLE EAST"]
# Lines in one file of ``arrival_order``, which one task sorts; at least so many files.
FILE_LINES = 500_000
LEAST_FILES = 5


def _deduped(spark, sf):
    return clean.deduplicate(fx.raw_orders(spark, sf), "order_id", ARRIVAL)


def _fixed(spark, sf):
    return clean.fix_quantities(_deduped(spark, sf))


def _cleaned(spark, sf):
    return clean_orders_plan(fx.raw_orders(spark, sf), ARRIVAL)


def _op(spark, sf):
    return fx.clean_orders(spark, sf), fx.clean_products(spark, sf)


def _ou(spark, sf):
    return fx.clean_orders(spark, sf), fx.clean_users(spark, sf)


def _opu(spark, sf):
    return (fx.clean_orders(spark, sf), fx.clean_products(spark, sf),
            fx.clean_users(spark, sf))


# ------------------------------------------------------------------ sources

def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv-round-trip")
    files.write_table(_cleaned(spark, sf), path, "csv")
    return files.read_csv(spark, path, CLEAN_ORDERS)


def arrival_order(spark, sf):
    """Raw orders stored as several files in key order, numbered as they stand there.

    The files grow in number with the lines, not in size, so no task sorts more.
    """
    path = scratch_path(spark, "arrival-order")
    n_files = max(LEAST_FILES, -(-fx.count_lines(spark, sf) // FILE_LINES))
    (fx.raw_orders(spark, sf).repartitionByRange(n_files, *ARRIVAL).sortWithinPartitions(*ARRIVAL)
     .write.parquet(path))
    return files.with_arrival_order(spark.read.parquet(path)).select(
        "order_id", "ord1", "ord2", "ord3", "_arrival")


def table_counts(spark, sf):
    return files.table_counts(users=fx.raw_users(spark, sf),
                              products=fx.raw_products(spark, sf),
                              orders=_cleaned(spark, sf))


# ------------------------------------------------------------------ cleaning

def dedup_orders(spark, sf):
    return _deduped(spark, sf).drop("ord1", "ord2", "ord3", "ord4")


def dedup_audit(spark, sf):
    return clean.dedup_audit(fx.raw_orders(spark, sf), "order_id", ARRIVAL)


def fix_quantities(spark, sf):
    return _fixed(spark, sf).drop("ord1", "ord2", "ord3", "ord4")


def quantity_audit(spark, sf):
    return clean.quantity_audit(_deduped(spark, sf), "quantity", "order_id", ARRIVAL)


def iqr_stats(spark, sf):
    return clean.price_stats(fx.raw_products(spark, sf))


def price_outliers(spark, sf):
    return clean.flag_price_outliers(fx.raw_products(spark, sf))


def cap_price_outliers(spark, sf):
    return clean.cap_price_outliers(fx.raw_products(spark, sf))


def price_correction_log(spark, sf):
    return clean.price_correction_log(fx.raw_products(spark, sf))


def parse_dates(spark, sf):
    orders = fx.raw_orders(spark, sf)
    parsed = clean.parse_order_dates(
        orders.withColumnRenamed("order_date", "order_date_raw")
        .withColumn("order_date", F.col("order_date_raw")))
    return parsed.select("order_id", "ord1", "ord2", "ord3", "ord4",
                         "order_date_raw", "order_date",
                         F.date_format("order_date", "yyyy-MM-dd HH:mm:ss")
                         .alias("order_date_text"))


def parse_dates_inferred(spark, sf):
    dates = fx.mixed_dates(spark, sf)
    return clean.parse_order_dates(
        dates.withColumn("order_date_raw", F.col("order_date")), fmt="infer")


def orphan_users(spark, sf):
    return quality.orphans(_cleaned(spark, sf), fx.raw_users(spark, sf),
                           "user_id").select("order_id", "user_id")


def orphan_products(spark, sf):
    return quality.orphans(_cleaned(spark, sf), fx.raw_products(spark, sf),
                           "product_id").select("order_id", "product_id")


def unknown_stages(spark, sf):
    return quality.unknown_stages(_cleaned(spark, sf))


def validation_report(spark, sf):
    # the price repair changes neither keys nor which prices are missing
    orders = _fixed(spark, sf).drop("ord1", "ord2", "ord3", "ord4")
    return quality.validation_report(fx.raw_users(spark, sf), fx.raw_products(spark, sf), orders)


def orders_profile(spark, sf):
    return quality.orders_profile(_cleaned(spark, sf))


def stage_mix(spark, sf):
    return quality.stage_mix(_cleaned(spark, sf))


def clean_orders(spark, sf):
    return _cleaned(spark, sf)


# ------------------------------------------------------------------ analytics

def weekly_kpis(spark, sf):
    o, p = _op(spark, sf)
    return metrics.weekly_kpis(o, p).orderBy("year", "week_num")


def weekly_kpis_iso(spark, sf):
    o, p = _op(spark, sf)
    return metrics.weekly_kpis(o, p, iso_year=True).orderBy("year", "week_num")


def weekly_growth(spark, sf):
    o, p = _op(spark, sf)
    return metrics.weekly_growth(metrics.weekly_kpis(o, p)) \
        .orderBy("year", "week_num")


def weekly_report(spark, sf):
    o, p = _op(spark, sf)
    return report.weekly_report(metrics.weekly_growth(metrics.weekly_kpis(o, p)))


def funnel_q(spark, sf):
    return funnel.funnel(fx.clean_orders(spark, sf))


def dropoff_q(spark, sf):
    o, u = _ou(spark, sf)
    return dropoff.checkout_dropoff(o, u)


def dropoff_ranked(spark, sf):
    o, u = _ou(spark, sf)
    return dropoff.rank_dropoff(dropoff.checkout_dropoff(o, u))


def dropoff_report(spark, sf):
    o, u = _ou(spark, sf)
    return dropoff.dropoff_report(dropoff.checkout_dropoff(o, u))


def worst_segment(spark, sf):
    o, u = _ou(spark, sf)
    return dropoff.worst_segment(dropoff.checkout_dropoff(o, u))


def kpi_totals(spark, sf):
    o, p, u = _opu(spark, sf)
    return metrics.kpi_totals(o, p, u, segment_filter(KPI_REGIONS, []))


def weekly_revenue_segment(spark, sf):
    o, p, u = _opu(spark, sf)
    return metrics.weekly_revenue(o, p, u, segment_filter([], TREND_CHANNELS)) \
        .orderBy("year", "week_num")


def funnel_segment(spark, sf):
    o, u = _ou(spark, sf)
    return funnel.funnel_segment(o, u, segment_filter(FUNNEL_REGIONS,
                                                      FUNNEL_CHANNELS))


def dropoff_segment(spark, sf):
    o, u = _ou(spark, sf)
    return dropoff.dropoff_segment(o, u, segment_filter(DROPOFF_REGIONS, []))


def segment_values(spark, sf):
    return segment_values_plan(fx.clean_users(spark, sf))


def currency_format(spark, sf):
    o, p, u = _opu(spark, sf)
    return report.region_currency(o, p, u).orderBy("region")


def segment_report_text(spark, sf):
    o, u = _ou(spark, sf)
    return report.segment_report_text(dropoff.checkout_dropoff(o, u)) \
        .orderBy("region")


QUERIES: dict[str, Query] = {
    "csv_round_trip": csv_round_trip,
    "arrival_order": arrival_order,
    "table_counts": table_counts,
    "dedup_orders": dedup_orders,
    "dedup_audit": dedup_audit,
    "fix_quantities": fix_quantities,
    "quantity_audit": quantity_audit,
    "iqr_stats": iqr_stats,
    "price_outliers": price_outliers,
    "cap_price_outliers": cap_price_outliers,
    "price_correction_log": price_correction_log,
    "parse_dates": parse_dates,
    "parse_dates_inferred": parse_dates_inferred,
    "orphan_users": orphan_users,
    "orphan_products": orphan_products,
    "unknown_stages": unknown_stages,
    "validation_report": validation_report,
    "orders_profile": orders_profile,
    "stage_mix": stage_mix,
    "clean_orders": clean_orders,
    "weekly_kpis": weekly_kpis,
    "weekly_kpis_iso": weekly_kpis_iso,
    "weekly_growth": weekly_growth,
    "weekly_report": weekly_report,
    "funnel": funnel_q,
    "dropoff": dropoff_q,
    "dropoff_ranked": dropoff_ranked,
    "dropoff_report": dropoff_report,
    "worst_segment": worst_segment,
    "kpi_totals": kpi_totals,
    "weekly_revenue_segment": weekly_revenue_segment,
    "funnel_segment": funnel_segment,
    "dropoff_segment": dropoff_segment,
    "segment_values": segment_values,
    "currency_format": currency_format,
    "segment_report_text": segment_report_text,
}
