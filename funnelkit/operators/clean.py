"""Cleaning operators: keep-first dedup, quantity repair, IQR price repair, dates.

All functions are lazy DataFrame -> DataFrame. Statistics that steer a row
decision (the fence, the replacement price) are one-row aggregates used as
scalar subqueries: Spark evaluates each once and applies it as a literal; no
value is collected by this code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions.dates import INFER, LAYOUTS, iso_text, parse_date, parse_timestamp
from funnelkit.operators.quantiles import (approx_quantiles, quantile_aggs,
                                          rank_table)
from funnelkit.sources.schemas import DATE_FORMAT, TIMESTAMP_FORMAT

_RN = "_rn"


def _ranked(df: DataFrame, key: str, order_by: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order_by)
    return df.withColumn(_RN, F.row_number().over(w))


# ---------------------------------------------------------------- dedup (C1-C3)

def deduplicate(df: DataFrame, key: str = "order_id",
                order_by: Sequence[str | Column] = ("_arrival",)) -> DataFrame:
    """Keep the first row of each ``key`` in ``order_by`` order.

    NULL keys form one group, as equal keys do. ``row_number() = 1`` lets
    Catalyst insert a partial ``WindowGroupLimit`` before the shuffle, so each
    map task forwards at most one row per key: a key holding a third of the
    table does not land whole in one task.
    """
    return _ranked(df, key, order_by).where(F.col(_RN) == 1).drop(_RN)


def first_copies(df: DataFrame, key: str = "order_id",
                 order_by: Sequence[str | Column] = ("_arrival",),
                 sample_size: int = 5) -> DataFrame:
    """The first ``sample_size + 1`` rows of each key with their number ``_rn`` from 1.

    Number 1 is what :func:`deduplicate` keeps; the first ``sample_size``
    duplicates of the whole table are among the others. The limit is applied
    before the shuffle, too.
    """
    return _ranked(df, key, order_by).where(F.col(_RN) <= sample_size + 1)


def duplicate_sample(copies: DataFrame, key: str = "order_id",
                     order_by: Sequence[str | Column] = ("_arrival",),
                     sample_size: int = 5) -> DataFrame:
    """One row, ``sample_duplicate_ids``: the first duplicates of ``first_copies`` by arrival."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    first_dups = copies.where(F.col(_RN) >= 2).orderBy(*order_cols).limit(sample_size)
    arrival = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order_cols)])
    return first_dups.agg(F.sort_array(F.collect_list(
        F.struct(arrival.alias("o"), F.coalesce(F.col(key).cast("string"), F.lit("NULL")).alias("k"))))
        .alias("s")).select(
        F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["k"]), ", "),
                 F.lit("]")).alias("sample_duplicate_ids"))


def dedup_audit(df: DataFrame, key: str = "order_id",
                order_by: Sequence[str | Column] = ("_arrival",),
                sample_size: int = 5) -> DataFrame:
    """One row: rows_before, duplicates_found, rows_after, sample_duplicate_ids.

    Counts come from ``groupBy(key).count()`` (map-side partial counts).
    The sample is the first ``sample_size`` duplicate rows in arrival order;
    those can only be among the first ``sample_size + 1`` rows of a key, so a
    bounded ``row_number`` (again with a map-side group limit) suffices.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counts = per_key.agg(F.sum("_n").cast("bigint").alias("rows_before"),
                         F.count(F.lit(1)).alias("rows_after"))
    counts = counts.select(
        F.coalesce("rows_before", F.lit(0).cast("bigint")).alias("rows_before"),
        (F.coalesce("rows_before", F.lit(0).cast("bigint"))
         - F.col("rows_after")).alias("duplicates_found"),
        "rows_after")
    copies = first_copies(df, key, order_by, sample_size)
    return counts.crossJoin(duplicate_sample(copies, key, order_by, sample_size))


# ------------------------------------------------------------ quantities (C4-C6)

def fix_quantities(df: DataFrame, column: str = "quantity") -> DataFrame:
    """Negative -> absolute value; drop rows equal to 0; keep NULL quantities."""
    q = F.col(column)
    return (df.where(~q.eqNullSafe(0))
            .withColumn(column, F.when(q < 0, F.abs(q)).otherwise(q)))


def quantity_audit(df: DataFrame, column: str = "quantity", key: str = "order_id",
                   order_by: Sequence[str | Column] = ("_arrival",),
                   sample_size: int = 5) -> DataFrame:
    """One row: negative count, zero count, total affected, before/after sample."""
    counts = df.agg(*quantity_counts(column))
    counts = counts.withColumn(
        "total_affected", F.col("negative_quantities") + F.col("zero_quantities"))
    return counts.crossJoin(negative_sample(df, column, key, order_by, sample_size))


def quantity_counts(column: str = "quantity") -> list[Column]:
    """The audit's counts as aggregates over deduplicated rows."""
    q = F.col(column)
    return [F.count_if(q < 0).alias("negative_quantities"),
            F.count_if(q == 0).alias("zero_quantities")]


def negative_sample(df: DataFrame, column: str = "quantity", key: str = "order_id",
                    order_by: Sequence[str | Column] = ("_arrival",),
                    sample_size: int = 5) -> DataFrame:
    """One row, ``negative_sample``: the first repaired quantities, before and after."""
    q = F.col(column)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    arrival = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order_cols)])
    line = F.concat(F.lit("order_id "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")), F.lit(": "),
                    q.cast("string"), F.lit(" -> "), F.abs(q).cast("string"))
    return (df.where(q < 0).orderBy(*order_cols).limit(sample_size)
            .agg(F.sort_array(F.collect_list(F.struct(arrival.alias("o"),
                                                      line.alias("t"))))
                 .alias("s"))
            .select(F.array_join(F.transform("s", lambda x: x["t"]), "; ")
                    .alias("negative_sample")))


# -------------------------------------------------------- price outliers (C7-C10)

STAT_COLUMNS = ("min_price", "q1", "median", "q3", "max_price", "iqr", "upper_fence")
PARAM_COLUMNS = STAT_COLUMNS + ("n_outliers", "replacement_price")


def outlier_params(products: DataFrame, column: str = "base_price",
                   exact: bool = True, ranges: int | None = None) -> DataFrame:
    """One row: the IQR statistics, the outlier count and the replacement.

    Exact mode builds one rank table of the values and answers everything from
    it: the quartiles; the fence; the non-outliers, which are exactly the
    sorted values up to the fence, i.e. a prefix of the ranks; and the median
    of that prefix. All intermediate results are one-row DataFrames.

    ``ranges`` sets the number of value ranges of the rank table (default:
    ``spark.sql.shuffle.partitions``, merged by adaptive execution when small);
    raise it for columns with billions of distinct values.
    """
    if not exact:
        return _approx_params(products, column)
    ranks = rank_table(products, column, ranges)
    aggs, outs = quantile_aggs(F.col("n"), [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    stats = ranks.agg(F.coalesce(F.max("n"), F.lit(0).cast("bigint")).alias("n"),
                      F.min("v").alias("min_price"), F.max("v").alias("max_price"),
                      *aggs).select("n", "min_price", "max_price", *outs)
    stats = stats.withColumn("iqr", F.col("q3") - F.col("q1"))
    stats = stats.withColumn("upper_fence", F.col("q3") + F.lit(1.5) * F.col("iqr"))
    # one-row sides below: proven-small broadcasts
    kept = ranks.crossJoin(F.broadcast(stats.select("upper_fence"))).agg(
        F.coalesce(F.max(F.when(F.col("v") <= F.col("upper_fence"), F.col("stop"))),
                   F.lit(0).cast("bigint")).alias("m"))
    aggs, outs = quantile_aggs(F.col("m"), [0.5], ["rest_median"])
    rest = ranks.crossJoin(F.broadcast(kept)).agg(*aggs).select(*outs)
    # m comes from its own one-row aggregate: an empty rank table still has m = 0
    return (stats.crossJoin(kept).crossJoin(rest)
            .withColumn("n_outliers", F.col("n") - F.col("m"))
            .withColumn("replacement_price", F.bround("rest_median", 2))
            .select(*PARAM_COLUMNS))


def _approx_params(products: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    v = F.when(~F.isnan(v), v)
    qs = approx_quantiles(products, column, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    ext = products.agg(F.min(v).alias("min_price"), F.max(v).alias("max_price"))
    stats = ext.crossJoin(qs).withColumn("iqr", F.col("q3") - F.col("q1"))
    stats = stats.withColumn("upper_fence", F.col("q3") + F.lit(1.5) * F.col("iqr"))
    fence = stats.select("upper_fence").scalar()
    flagged = products.select(_outlier(column, fence).alias("_out"), column)
    med = approx_quantiles(flagged.where(~F.col("_out")), column, [0.5],
                           names=["rest_median"])
    n_out = flagged.agg(F.count_if(F.col("_out")).alias("n_outliers"))
    return (stats.crossJoin(n_out).crossJoin(med)
            .withColumn("replacement_price", F.bround("rest_median", 2))
            .select(*PARAM_COLUMNS))


def price_stats(products: DataFrame, column: str = "base_price",
                exact: bool = True) -> DataFrame:
    """One row: min, Q1, median, Q3, max, IQR and upper fence Q3 + 1.5 IQR."""
    return outlier_params(products, column, exact).select(*STAT_COLUMNS)


def _outlier(column: str, fence) -> Column:
    v = F.col(column)
    return F.coalesce(~F.isnan(v) & (v > fence), F.lit(False))


def flag_price_outliers(products: DataFrame, column: str = "base_price",
                        stats: DataFrame | None = None,
                        flag: str = "is_outlier", exact: bool = True) -> DataFrame:
    """Add ``flag``: value strictly above the upper fence (no lower fence).

    NULL / NaN values are not outliers. The fence is a scalar subquery over the
    one-row statistics: Spark computes it once and uses it as a literal, and
    a projection that does not need ``flag`` drops the whole computation.
    """
    stats = stats if stats is not None else price_stats(products, column, exact)
    fence = stats.select("upper_fence").scalar()
    return products.withColumn(flag, _outlier(column, fence))


def replacement_price(products: DataFrame, column: str = "base_price",
                      exact: bool = True) -> DataFrame:
    """One row: n_outliers and the median of the non-outliers (bround 2)."""
    return outlier_params(products, column, exact).select(
        "n_outliers", "replacement_price")


def _with_replacement(products: DataFrame, column: str, exact: bool) -> DataFrame:
    params = outlier_params(products, column, exact).select(
        F.struct("upper_fence", "replacement_price").alias("p")).scalar()
    return products.withColumns({
        "is_outlier": _outlier(column, params.getField("upper_fence")),
        "replacement_price": params.getField("replacement_price")})


def cap_price_outliers(products: DataFrame, column: str = "base_price",
                       exact: bool = True) -> DataFrame:
    """Replace flagged values by the rounded median of the other values.

    (Called capping, but the value is the median, not the fence.) With no
    outliers nothing changes.
    """
    df = _with_replacement(products, column, exact)
    fixed = F.when(F.col("is_outlier"), F.col("replacement_price")) \
        .otherwise(F.col(column))
    return df.withColumn(column, fixed).drop("is_outlier", "replacement_price")


def price_correction_log(products: DataFrame, column: str = "base_price",
                         key: str = "product_id", name: str = "product_name",
                         exact: bool = True) -> DataFrame:
    """One row per corrected product: original, corrected and delta."""
    df = _with_replacement(products, column, exact).where(F.col("is_outlier"))
    return df.select(key, name,
                     F.col(column).alias("original_price"),
                     F.col("replacement_price").alias("corrected_price"),
                     (F.col(column) - F.col("replacement_price")).alias("delta"))


# ------------------------------------------------------------- dates (C11, C13)

def infer_layouts(df: DataFrame, column: str, layouts: Sequence[str] = LAYOUTS) -> list[str]:
    """The layouts that fit values of ``column``, most hits first.

    One aggregate over the column counts for each layout the values that it reads
    (at most ``len(layouts)`` numbers come to the driver). So ``03/01/2024`` is the
    third of January where the column's other values show that the day comes
    first, and the first of March otherwise. Values of several layouts are read
    one by one, in this order. A column that no layout fits gets the first one.
    """
    votes = df.agg(*[F.count(parse_timestamp(column, f)).alias(str(i)) for i, f in enumerate(layouts)]).first()
    order = sorted(range(len(layouts)), key=lambda i: (-votes[i], i))
    return [layouts[i] for i in order if votes[i]] or [layouts[0]]


def _layouts(df: DataFrame, column: str, fmt: str | Sequence[str]) -> str | Sequence[str]:
    return infer_layouts(df, column) if fmt == INFER else fmt


def parse_order_dates(orders: DataFrame, column: str = "order_date",
                      fmt: str | Sequence[str] = TIMESTAMP_FORMAT) -> DataFrame:
    """Text dates -> TIMESTAMP_NTZ; unparseable text -> NULL. ``"infer"`` votes (one job)."""
    return orders.withColumn(column, parse_timestamp(column, _layouts(orders, column, fmt)))


def parse_signup_dates(users: DataFrame, column: str = "signup_date",
                       fmt: str | Sequence[str] = DATE_FORMAT) -> DataFrame:
    """Text dates -> DATE; unparseable text -> NULL. ``"infer"`` votes (one job)."""
    return users.withColumn(column, parse_date(column, _layouts(users, column, fmt)))


def normalise_dates(df: DataFrame, column: str,
                    fmt: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Typed dates -> ISO text (for text sinks)."""
    return df.withColumn(column, iso_text(column, fmt))
