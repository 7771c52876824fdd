"""Readers and writers for the three tables (CSV at the edges, Parquet inside).

Schemas are always declared; nothing is inferred. A path that does not exist
makes Spark raise ``PATH_NOT_FOUND`` when the read is planned; ``read_tables``
checks all paths first so the error lists every missing one at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.functions.dates import parse_date, parse_timestamp
from funnelkit.sources import schemas
from funnelkit.sources.records import csv_records
from funnelkit.sources.schemas import BAD, RECORD

TABLES = ("users", "products", "orders")


def _missing(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if not hp.getFileSystem(conf).exists(hp):
            out.append(p)
    return out


def _text_columns(spark: SparkSession, path: str, multiline: bool | str, broken: bool) -> DataFrame:
    """The file's columns as text, by header name; ``broken`` adds ``_record``, the text of
    records with too many or too few fields. Split reading adds ``_arrival``."""
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": RECORD}
    names = (spark.read.options(**options, header=True, multiLine=bool(multiline)).csv(path).columns)
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if broken:
        layout.add(RECORD, T.StringType())
    if multiline == "split":
        parsed = F.from_csv("record", ", ".join(f"`{f.name.replace('`', '``')}` string" for f in layout),
                            {**options, "multiLine": "true"})
        return (csv_records(spark, path).where(~F.col("first"))
                .select(parsed.alias("r"), "_arrival").select("r.*", "_arrival"))
    return spark.read.options(**options, header=True, multiLine=multiline).schema(layout).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             timestamp_format: str = schemas.TIMESTAMP_FORMAT,
             date_format: str = schemas.DATE_FORMAT, multiline: bool | str = True,
             keep_bad: bool = False) -> DataFrame:
    """Columns of ``schema`` by header name; a missing one raises, others are ignored.

    Everything is read as text and converted: ``3.0`` is a whole number, NaN is
    NULL, text that does not convert is NULL. ``keep_bad`` adds ``_bad``, a map
    from column to such a text (NULL if there is none), which the numeric check
    of ``validation_report`` counts; under ``_record`` it holds the whole text of
    a record with too many or too few fields, whose missing fields are NULL.

    Quotes inside quoted fields are doubled, and fields may hold line breaks.
    ``multiline=True`` parses each file in one task, ``"split"`` reads it in as
    many as Spark likes (see ``records``) and adds ``_arrival``, ``False`` splits
    too but takes every line break as the end of a record.
    """
    text = _text_columns(spark, path, multiline, keep_bad)
    absent = [f.name for f in schema if f.name not in text.columns]
    if absent:
        raise ValueError(f"{path}: no column " + ", ".join(absent))

    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        number = F.trim(c).try_cast("double")
        if isinstance(f.dataType, T.IntegralType):
            whole = F.when(number == F.floor(number), number.try_cast("bigint"))
            return F.coalesce(F.trim(c).try_cast("bigint"), whole).cast(f.dataType)
        if isinstance(f.dataType, T.FractionalType):
            return F.when(~F.isnan(number), number).cast(f.dataType)
        if isinstance(f.dataType, T.DateType):
            return parse_date(c, date_format)
        if isinstance(f.dataType, T.TimestampNTZType):
            return parse_timestamp(c, timestamp_format)
        return c

    def bad(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        wrong = c.isNotNull() & value(f).isNull()
        if isinstance(f.dataType, T.NumericType):
            wrong &= ~F.lower(F.trim(c)).isin("nan", "")
        return F.struct(F.lit(f.name).alias("key"), F.when(wrong, c).alias("value"))

    columns = [value(f).alias(f.name) for f in schema]
    if keep_bad:
        whole = F.struct(F.lit(RECORD).alias("key"), F.col(RECORD).alias("value"))
        found = F.filter(F.array(*map(bad, schema), whole), lambda e: e["value"].isNotNull())
        columns.append(F.when(F.size(found) > 0, F.map_from_entries(found)).alias(BAD))
    if multiline == "split":
        columns.append(F.col("_arrival"))
    return text.select(*columns)


def read_tables(spark: SparkSession, paths: dict[str, str],
                fmt: str = "csv", raw: bool = True, keep_bad: bool = False,
                multiline: bool | str = True) -> dict[str, DataFrame]:
    """Read users / products / orders; raise one error naming all missing paths."""
    missing = _missing(spark, [paths[t] for t in TABLES])
    if missing:
        raise FileNotFoundError("missing input tables: " + ", ".join(missing))
    layout = {
        "users": schemas.RAW_USERS if raw else schemas.CLEAN_USERS,
        "products": schemas.RAW_PRODUCTS if raw else schemas.CLEAN_PRODUCTS,
        "orders": schemas.RAW_ORDERS if raw else schemas.CLEAN_ORDERS,
    }
    if fmt == "csv":
        return {t: read_csv(spark, paths[t], layout[t], keep_bad=keep_bad, multiline=multiline)
                for t in TABLES}
    return {t: spark.read.schema(layout[t]).parquet(paths[t]) for t in TABLES}


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Write one table; CSV gets a header row, doubled quotes and the ISO date layouts."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        (writer.option("header", True).option("quote", '"').option("escape", '"')
         .option("timestampNTZFormat", schemas.TIMESTAMP_FORMAT)
         .option("dateFormat", schemas.DATE_FORMAT)
         .csv(path))
    else:
        writer.parquet(path)


def with_arrival_order(df: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Add ``_arrival``, which orders rows as they appear in the files.

    Parquet: one long, the rows ahead of a row in all files by path: rows per file
    and their prefix sums (one row per file, broadcast, so that no file's rows meet in
    one task), plus the row's index in its file. A split CSV read has its line numbers already. CSV files read whole get a
    struct of file path, split start and a per-split increasing id. Must be
    applied directly on a file read.
    """
    if "_arrival" in df.columns:
        return df
    meta = F.col("_metadata")
    if fmt != "parquet":
        return df.withColumn("_arrival", F.struct(
            meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos")))
    file = meta.getField("file_path").alias("_file")
    ahead = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    starts = df.select(file).groupBy("_file").agg(F.count("*").alias("n")).select(
        "_file", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("bigint")).alias("_start"))
    return (df.select("*", file, meta.getField("row_index").alias("_index")).join(F.broadcast(starts), "_file")
            .withColumn("_arrival", F.col("_start") + F.col("_index")).select(*df.columns, "_arrival"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """``(table_name, n_rows)``, one global count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
