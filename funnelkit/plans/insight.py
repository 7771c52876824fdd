"""Drop-off insight inputs: the report table, the worst segment, Markdown.

The text generation that followed in the source application is a call to an
external language-model service and is not part of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelkit.operators.dropoff import (checkout_dropoff, dropoff_report,
                                         worst_segment)
from funnelkit.operators.report import segment_report_text


def insight_tables(orders: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    drop = checkout_dropoff(orders, users)
    return {
        "report": dropoff_report(drop),
        "worst": worst_segment(drop),
        "markdown": segment_report_text(drop),
    }
