"""The cleaning job: dedup -> quantity repair -> price repair -> dates -> write -> validate.

``clean_tables`` builds the plans; for exact price statistics it also writes one
rank table of the distinct prices to the checkpoint folder. ``run_cleaning``
reads, cleans and writes, and observes the reports' counts on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.functions.dates import INFER
from funnelkit.operators.clean import (cap_price_outliers, deduplicate, duplicate_sample,
                                       first_copies, fix_quantities, infer_layouts,
                                       negative_sample,
                                       parse_order_dates, parse_signup_dates,
                                       price_correction_log, quantity_counts)
from funnelkit.operators.quality import (check_pass, row_checks, stage_counts, stage_rows,
                                         validation_rows)
from funnelkit.session import remove_path, scratch_path
from funnelkit.sources import files
from funnelkit.sources.schemas import (BAD, CLEAN_ORDERS, DATE_FORMAT,
                                       TIMESTAMP_FORMAT)
from funnelkit.sources.versions import new_version, publish

_COUNTS = T.LongType()


def clean_orders(orders: DataFrame,
                 order_by: Sequence[str | Column] = ("_arrival",),
                 order_fmt: str | Sequence[str] = TIMESTAMP_FORMAT) -> DataFrame:
    """Raw orders -> deduplicated, repaired, typed orders (cleaned layout)."""
    return clean_kept(deduplicate(orders, "order_id", order_by), order_fmt)


def clean_kept(kept: DataFrame, order_fmt: str | Sequence[str] = TIMESTAMP_FORMAT) -> DataFrame:
    """Deduplicated orders -> repaired, typed orders (cleaned layout)."""
    out = parse_order_dates(fix_quantities(kept), "order_date", order_fmt)
    return out.select(*CLEAN_ORDERS.fieldNames())


def clean_tables(users: DataFrame, products: DataFrame, orders: DataFrame,
                 order_by: Sequence[str | Column] = ("_arrival",),
                 exact: bool = True, signup_fmt: str | Sequence[str] = DATE_FORMAT,
                 order_fmt: str | Sequence[str] = TIMESTAMP_FORMAT) -> dict[str, DataFrame]:
    return {
        "users": parse_signup_dates(users, "signup_date", signup_fmt),
        "products": cap_price_outliers(products, exact=exact),
        "orders": clean_orders(orders, order_by, order_fmt),
    }


def run_cleaning(spark: SparkSession, inputs: dict[str, str], out_dir: str,
                 in_fmt: str = "csv", out_fmt: str = "parquet", exact: bool = True,
                 signup_fmt: str | Sequence[str] = INFER,
                 order_fmt: str | Sequence[str] = INFER,
                 multiline: bool | str = "split", versioned: bool = False) -> dict[str, str]:
    """Read the raw tables, clean and write them, then validate and audit.

    Writes ``cleaned_<table>`` below ``out_dir`` and, as Parquet, the reports:
    validation, dedup_audit, quantity_audit, price_corrections, orders_profile
    and stage_mix. Returns all paths by name.

    The raw orders are read twice (once only to count them) and shuffled once:
    the first copies of each key are stored in the checkpoint folder until the job
    ends, and everything else starts from there. Counts of the audits, the date
    range and the stage mix are observed while the cleaned orders are written, in
    the writing stage itself, so that a task run again does not count twice.
    Date layouts are voted for by the columns' own values (``infer_layouts``) unless
    named. CSV files are read in splits, with line breaks inside fields (see ``read_csv``
    for the other values of ``multiline``). ``versioned`` writes everything to a new
    folder below ``out_dir`` and publishes it in one step at the end
    (``versions.published`` gives the paths), so readers never see half a job.
    """
    if versioned:
        out = run_cleaning(spark, inputs, new_version(out_dir), in_fmt, out_fmt, exact, signup_fmt,
                           order_fmt, multiline)
        publish(spark, out_dir, out)
        return out
    raw = files.read_tables(spark, inputs, fmt=in_fmt, raw=True, keep_bad=in_fmt == "csv",
                            multiline=multiline)
    raw["orders"] = files.with_arrival_order(raw["orders"], in_fmt)
    out = {name: f"{out_dir.rstrip('/')}/cleaned_{name}" for name in files.TABLES}
    if signup_fmt == INFER:
        signup_fmt = infer_layouts(raw["users"], "signup_date")
    files.write_table(parse_signup_dates(raw["users"].drop(BAD, "_arrival"), "signup_date", signup_fmt),
                      out["users"], out_fmt)
    prices = raw["products"].drop(BAD, "_arrival")
    files.write_table(cap_price_outliers(prices, exact=exact), out["products"], out_fmt)

    scratch = scratch_path(spark, "first-copies")
    try:
        first_copies(raw["orders"]).write.parquet(scratch)
        copies = spark.read.parquet(scratch)
        kept = copies.where("_rn = 1").drop("_rn")
        if order_fmt == INFER:
            order_fmt = infer_layouts(kept, "order_date")
        before, after = Observation("kept"), Observation("cleaned")
        watched = kept.observe(before, F.count(F.lit(1)).alias("rows_after"), *quantity_counts())
        clean = clean_kept(watched, order_fmt).observe(
            after, F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"), *stage_counts())
        files.write_table(clean, out["orders"], out_fmt)
        checks = (raw["users"], raw["products"], fix_quantities(kept), signup_fmt, order_fmt)
        checked = _row_of(spark, check_pass(*checks).first().asDict(), _COUNTS)
        reports = {
            # numbers and dates are judged on the text as it came; the price repair changes
            # neither keys nor which prices are missing
            "validation": validation_rows(checked, row_checks(*checks)),
            "dedup_audit": _row_of(spark, {
                "rows_before": raw["orders"].count(), "rows_after": before.get["rows_after"]}, _COUNTS)
            .select("rows_before", (F.col("rows_before") - F.col("rows_after"))
                    .alias("duplicates_found"), "rows_after").crossJoin(duplicate_sample(copies)),
            "quantity_audit": _row_of(spark, before.get, _COUNTS).select(
                "negative_quantities", "zero_quantities",
                (F.col("negative_quantities") + F.col("zero_quantities")).alias("total_affected"))
            .crossJoin(negative_sample(kept)),
            "price_corrections": price_correction_log(prices, exact=exact),
            "orders_profile": _row_of(spark, after.get, _COUNTS).crossJoin(checked).select(
                F.col("_total").alias("total_orders"), "unique_users", "unique_products",
                "first_order_date", "last_order_date"),
            "stage_mix": stage_rows(_row_of(spark, after.get, _COUNTS)),
        }
        for name, df in reports.items():
            out[name] = f"{out_dir.rstrip('/')}/{name}"
            files.write_table(df, out[name], "parquet")
    finally:
        remove_path(spark, scratch)
    return out


def _row_of(spark: SparkSession, values: dict, kind: T.DataType) -> DataFrame:
    """A one-row DataFrame of counts (and dates) that came to the driver."""
    fields = [T.StructField(k, T.TimestampNTZType() if k.endswith("_date") else kind) for k in values]
    return spark.createDataFrame([tuple(values.values())], T.StructType(fields))
