"""Column-level helpers: each returns a ``pyspark.sql.Column``."""

from funnelkit.functions.dates import iso_text, parse_date, parse_timestamp
from funnelkit.functions.money import (average_order_value, checked_sum, money,
                                       price_digits, price_product, total_amount)
from funnelkit.functions.segments import segment_filter
from funnelkit.functions.stages import is_known_stage, stage_order
from funnelkit.functions.text import (cell_text, concat_text, currency_text,
                                      integer_text, markdown_row, pct_text)

__all__ = [
    "average_order_value", "cell_text", "concat_text", "currency_text",
    "integer_text", "is_known_stage", "iso_text", "markdown_row",
    "money", "price_digits", "price_product", "checked_sum", "total_amount", "parse_date", "parse_timestamp", "pct_text",
    "segment_filter", "stage_order",
]
