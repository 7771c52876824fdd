"""Shared-folder tables and size-checked joins used by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from funnelkit.session import scratch_path

#: rows that may be broadcast; callers use it for rows of at most some 40 bytes
BROADCAST_ROWS = 1_000_000


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at files that every executor can read again, so a lost
    executor costs no recomputation before this point.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(docs: DataFrame, *more: Column) -> DataFrame:
    """``row`` (struct of all columns of ``docs``) and ``more``; whole texts travel once.

    ``text`` is added as a column of its own only where the struct does not hold
    it as a string (see ``words.texts_of``).
    """
    plain = [f for f in docs.schema if f.name == "text" and f.dataType == StringType()]
    text = [] if len(plain) == 1 else [F.col("text").cast("string").alias("text")]
    return docs.select(F.struct("*").alias("row"), *more, *text)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a wide shuffle: the session's setting, which grows with the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most ``rows`` rows (reads no more than it must)."""
    return table.select(F.lit(1)).limit(rows + 1).count() <= rows


def sized(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` with a broadcast hint if its rows are few, else unhinted.

    The unhinted table is joined as Spark sees fit: a sort-merge join whose
    skewed partitions adaptive execution splits.
    """
    return F.broadcast(table) if is_small(table, rows) else table
