"""Table layouts and the fixed vocabulary of the order data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the source application's) ----------------------
# Funnel stages in their logical order; position + 1 is the step number.
STAGES = ("Visited", "Added to Cart", "Checkout Initiated", "Purchased")
PURCHASED = "Purchased"
CHECKOUT = "Checkout Initiated"
# Text layouts the cleaned tables are written with.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Columns the validation step requires to be numeric, as (table, column).
NUMERIC_COLUMNS = (
    ("users", "user_id"),
    ("products", "product_id"),
    ("products", "base_price"),
    ("orders", "order_id"),
    ("orders", "user_id"),
    ("orders", "product_id"),
    ("orders", "quantity"),
)
# ------------------------------------------------------------------------------

# map column of the CSV reader: column name -> text that did not convert
BAD = "_bad"
# its key for records with too many or too few fields (their whole text)
RECORD = "_record"

RAW_USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("signup_date", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("channel", T.StringType()),
])

RAW_PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("base_price", T.DoubleType()),
])

RAW_ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("order_stage", T.StringType()),
    T.StructField("order_date", T.StringType()),
])

CLEAN_USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("signup_date", T.DateType()),
    T.StructField("region", T.StringType()),
    T.StructField("channel", T.StringType()),
])

CLEAN_PRODUCTS = RAW_PRODUCTS

CLEAN_ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("order_stage", T.StringType()),
    T.StructField("order_date", T.TimestampNTZType()),
])
