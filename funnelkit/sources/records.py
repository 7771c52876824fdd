"""CSV records from files that Spark may split anywhere, line breaks in fields included.

A line with an odd number of quotes opens or closes a field that goes over
several lines, in turn. So lines are read as text (every file in many splits), the
odd lines of each split are counted, and a prefix sum over the splits of a file
(one row per split) tells each split how many odd lines lie ahead of it. With the
odd lines before it inside its split, every line then knows whether it is a
record of its own or part of record number ``ceil(odd / 2)``, and only the parts
are brought together, across split edges too.

Quotes stand around fields and are doubled inside them, as RFC 4180 has it and
``files.write_table`` writes. If a file ends inside a quoted field, its last odd
line and the lines after it are records of their own, so that one missing quote
cannot pull the rest of a file into one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, block, pos, odd``: lines in file order by the middle three."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos"))
            .withColumn("odd", (quotes % 2).cast("long")))


def _ended(line: Column) -> Column:
    """A line without the carriage return of a Windows line end."""
    return F.regexp_replace(line, r"\r$", "")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, first, _arrival``: each record's text, whether it is its file's first, its place.

    ``_arrival`` is the number of the record's first line, counted from 0 through
    all files in the order of their paths: one long that orders records as they
    stand. Empty lines outside of fields are left out.
    """
    lines = _lines(spark, path)
    in_file = Window.partitionBy("file")
    ever = Window.orderBy("file", "block")   # over one row per split
    splits = (lines.groupBy("file", "block").agg(F.sum("odd").alias("odds"), F.count("*").alias("n"))
              .withColumn("ahead", F.sum("odds").over(in_file.orderBy("block")) - F.col("odds"))
              .withColumn("total", F.sum("odds").over(in_file))
              .withColumn("start", F.sum("n").over(ever) - F.col("n")).drop("odds", "n"))
    in_split = Window.partitionBy("file", "block").orderBy("pos")
    marked = (lines.withColumn("here", F.sum("odd").over(in_split))
              .withColumn("nth", F.row_number().over(in_split))
              .withColumn("first", (F.col("block") == 0) & (F.col("nth") == 1))
              .join(splits, ["file", "block"])
              .withColumn("line", F.col("start") + F.col("nth") - 1)
              .withColumn("upto", F.col("ahead") + F.col("here")))
    before = F.col("upto") - F.col("odd")
    unclosed = (F.col("total") % 2 == 1) & (F.col("upto") == F.col("total"))
    alone = unclosed | ((before % 2 == 0) & (F.col("odd") == 0))
    single = (marked.where(alone).select(_ended(F.col("value")).alias("record"), "first",
                                         F.col("line").alias("_arrival"))
              .where("record <> ''"))
    parts = (marked.where(~alone).groupBy("file", F.ceil(F.col("upto") / F.lit(2)).alias("number"))
             .agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"),
                  F.max("first").alias("first")))
    joined = parts.select(
        _ended(F.array_join(F.transform("parts", lambda p: p["value"]), "\n")).alias("record"), "first",
        F.col("parts")[0]["line"].alias("_arrival"))
    return single.unionByName(joined)
