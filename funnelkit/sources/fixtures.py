"""Users / products / orders shaped from the TPC-H-like test tables.

Clean views have the cleaned layout; raw views add the dirt the cleaning steps
repair (duplicate order ids, negative and zero quantities, orphan keys, price
outliers, unparseable dates, an unknown stage). ``ord1..ord4`` order the rows
of one ``order_id`` and stand in for file position; with ``order_id`` in front
they are unique, so "first" is well defined at every scale.

Only the columns used are read, so the Parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: how test priorities map onto funnel stages -----------------
PRIORITY_STAGE = (
    ("5-LOW", "Visited"),
    ("3-MEDIUM", "Added to Cart"),
    ("2-HIGH", "Checkout Initiated"),
    ("1-URGENT", "Purchased"),
)
OTHER_STAGE = "Unspecified"
# ------------------------------------------------------------------------------

ARRIVAL = ["order_id", "ord1", "ord2", "ord3", "ord4"]


# Declared layouts of the test tables (the columns these views read): no
# schema-inference job per read, and a changed file type fails loudly.
TABLE_SCHEMAS = {
    "region": ("r_regionkey int, r_name string"),
    "nation": ("n_nationkey int, n_name string, n_regionkey int"),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, "
                        "c_acctbal double, c_mktsegment string"),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, "
                    "p_size int, p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                      "o_totalprice double, o_orderdate timestamp_ntz, "
                      "o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, "
                        "l_linenumber int, l_quantity double, l_extendedprice double, "
                        "l_discount double, l_tax double, l_returnflag string, "
                        "l_linestatus string, l_shipdate timestamp_ntz"),
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(
        f"{sf_dir.rstrip('/')}/{name}.parquet")


def _stage(priority: Column) -> Column:
    expr = None
    for prio, stage in PRIORITY_STAGE:
        expr = (F.when(priority == prio, stage) if expr is None
                else expr.when(priority == prio, stage))
    return expr.otherwise(OTHER_STAGE)


def _customers_with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) have a size fixed by the TPC-H
    # specification at every scale factor: broadcasting them is safe, and a
    # shuffle join on 25 keys would put all customers into 25 tasks.
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    customer = _read(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    return (customer
            .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
            .join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice")
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)


def count_lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``lineitem``, as the footers of its files give them."""
    return _read(spark, sf_dir, "lineitem").count()


def clean_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers_with_region(spark, sf_dir).select(
        F.col("c_custkey").alias("user_id"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("channel"))


def clean_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_retailprice").alias("base_price"))


def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, so distinct order counts have work to do."""
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("o_orderdate").alias("order_date"),
        _stage(F.col("o_orderpriority")).alias("order_stage"))


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    signup = F.date_format(
        F.date_add(F.lit("2020-01-01").cast("date"), (key % 365).cast("int")),
        "yyyy-MM-dd")
    return _customers_with_region(spark, sf_dir).select(
        key.alias("user_id"),
        F.when(key % 83 == 0, F.lit("unknown")).otherwise(signup)
        .alias("signup_date"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("channel"))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    price = F.col("p_retailprice")
    return _read(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.when(key % 97 == 0, price * 50).otherwise(price).alias("base_price"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    okey = F.col("l_orderkey")
    return _lines(spark, sf_dir).select(
        okey.alias("order_id"),
        F.when(okey % 97 == 0, F.col("o_custkey") + 1000000)
        .otherwise(F.col("o_custkey")).alias("user_id"),
        F.when(F.col("l_partkey") % 103 == 0, F.lit(-1).cast("bigint"))
        .otherwise(F.col("l_partkey")).alias("product_id"),
        (F.col("l_quantity").cast("bigint") - 3).alias("quantity"),
        F.when(okey % 101 == 0, F.lit("not-a-date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("order_date"),
        _stage(F.col("o_orderpriority")).alias("order_stage"),
        F.col("l_linenumber").alias("ord1"),
        F.col("l_partkey").alias("ord2"),
        F.col("l_suppkey").alias("ord3"),
        F.col("l_extendedprice").alias("ord4"))


def mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text in several layouts, days first; some are no dates."""
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.date_format(when, "dd/MM/yyyy HH:mm:ss")
    for rest, layout in ((1, "dd/MM/yyyy"), (2, "yyyy-MM-dd HH:mm:ss"), (3, "yyyy-MM-dd"),
                         (4, "dd.MM.yyyy")):
        text = F.when(key % 7 == rest, F.date_format(when, layout)).otherwise(text)
    text = F.when(key % 101 == 0, F.lit("not-a-date")).when(key % 103 == 0, F.lit("31/02/2024")).when(
        key % 107 == 0, F.lit(None)).otherwise(text)
    return _read(spark, sf_dir, "orders").select(key.alias("order_id"), text.alias("order_date"))
