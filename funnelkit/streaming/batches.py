"""Micro-batch cleaning of a raw-orders file stream via ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelkit.operators.clean import fix_quantities, parse_order_dates
from funnelkit.sources.schemas import CLEAN_ORDERS


def clean_batches(stream: DataFrame, out_path: str, checkpoint: str,
                  fmt: str = "parquet"):
    """Start a query that repairs quantities and dates of each micro-batch.

    Each micro-batch is written to its own ``epoch=<id>`` folder with
    overwrite, so a batch replayed after a failure replaces its earlier
    partial output instead of adding duplicates. Deduplication across batches
    would need state over all order ids ever seen; it is left to the batch job
    over the landed output.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        out = (batch.transform(fix_quantities).transform(parse_order_dates)
               .select(*CLEAN_ORDERS.fieldNames()))
        out.write.mode("overwrite").format(fmt).save(f"{out_path.rstrip('/')}/epoch={epoch}")

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).start())
