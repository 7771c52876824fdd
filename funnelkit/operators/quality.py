"""Validation and profiling of the cleaned tables.

The validation report is a DataFrame ``(check_name, column_name, n_issues,
counted)``. ``counted`` marks the rows that add to the issue total (NULL counts
are shown but, as in the source application, not added).

All checks come from one pass (:func:`check_pass`). Orders, users and products
are united into one relation and aggregated under four grouping sets: by user, by
product, by stage, and by the set of row-local checks that a row fails (a bit
mask, nearly always 0). A key group then knows how many orders use it and whether
its dimension has it, so orphans need no join; each table is read once, shuffled
once, and a hot or NULL key is one row per task. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.functions.dates import parse_date, parse_timestamp
from funnelkit.functions.stages import is_known_stage
from funnelkit.sources.schemas import (BAD, DATE_FORMAT, NUMERIC_COLUMNS, RECORD, STAGES,
                                       TIMESTAMP_FORMAT)


def orphans(orders: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Orders whose ``key`` matches no dimension row (NULL keys included).

    A left anti join keeps rows with a NULL key, which never match. They carry a
    salt (0 for all others, and in the dimension), so that they do not meet in
    one partition. A small dimension is broadcast by its measured size; a skewed
    key on the order side is split by adaptive execution.
    """
    k = F.col(key)
    salt = F.when(k.isNull(), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in orders.columns
                                           if c != key and _hashable(orders.schema[c].dataType)]))
    salted = orders.withColumn("_salt", F.coalesce(salt, F.lit(0).cast("bigint")))
    known = dimension.select(key, F.lit(0).cast("bigint").alias("_salt")).where(k.isNotNull())
    return salted.join(known, [key, "_salt"], "left_anti").drop("_salt")


def _hashable(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.AtomicType)


def unknown_stages(orders: DataFrame, column: str = "order_stage") -> DataFrame:
    """Distinct stage values outside the four known ones, NULL included.

    Filtering before ``distinct`` keeps the shuffle to the unknown values.
    """
    return orders.where(~is_known_stage(column)).select(column).distinct()


def _missing(c: str, dtype: T.DataType) -> Column:
    col = F.col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _row(check: str, column: str, n: Column, counted: bool) -> Column:
    return F.struct(F.lit(check).alias("check_name"),
                    F.lit(column).alias("column_name"),
                    n.cast("bigint").alias("n_issues"),
                    F.lit(counted).alias("counted"))


def _kept(name: str) -> Column:
    """Whether the CSV reader kept a text under ``name``."""
    return F.col(BAD).isNotNull() & F.map_contains_key(F.coalesce(
        F.col(BAD), F.create_map(F.lit(""), F.lit(""))), name)


def _not_numeric(table: DataFrame, column: str) -> Column:
    """Whether a present value is no number: text the CSV reader kept, or a text column's own."""
    if BAD in table.columns:
        return _kept(column)
    c = F.col(column)
    if isinstance(table.schema[column].dataType, T.NumericType):
        return F.lit(False)
    # a text column is numeric when every present value parses as one
    # (as a reader that infers types would see it)
    return c.isNotNull() & c.cast("string").try_cast("double").isNull()


def row_checks(users: DataFrame, products: DataFrame, orders: DataFrame,
               signup_fmt: str | Sequence[str] = DATE_FORMAT,
               order_fmt: str | Sequence[str] = TIMESTAMP_FORMAT
               ) -> list[tuple[str, str, str, Column]]:
    """The row-local checks: (check, table, column, whether a row of the table fails it)."""
    tables = {"users": users, "products": products, "orders": orders}
    checks = [("unparseable_date", "users", "signup_date", parse_date("signup_date", signup_fmt).isNull()),
              ("unparseable_date", "orders", "order_date", parse_timestamp("order_date", order_fmt).isNull())]
    for table, df in tables.items():   # records with too many or too few fields
        if BAD in df.columns:
            checks.append(("broken_record", table, "all", _kept(RECORD)))
    for table, column in NUMERIC_COLUMNS:
        dtype = tables[table].schema[column].dataType
        checks += [("not_numeric", table, column, _not_numeric(tables[table], column)),
                   ("null_values", table, column, _missing(column, dtype))]
    return checks


def check_pass(users: DataFrame, products: DataFrame, orders: DataFrame,
               signup_fmt: str | Sequence[str] = DATE_FORMAT,
               order_fmt: str | Sequence[str] = TIMESTAMP_FORMAT) -> DataFrame:
    """One row: ``check_<i>`` (rows that fail the i-th row check), ``orphan_user_id``,
    ``orphan_product_id``, ``unknown_stages``, ``unique_users`` and ``unique_products``."""
    tables = {"users": users, "products": products, "orders": orders}
    checks = row_checks(users, products, orders, signup_fmt, order_fmt)
    keys = {"user_id": "users", "product_id": "products", "order_stage": None}

    def part(name: str) -> DataFrame:
        bits = [F.when(F.coalesce(fails, F.lit(False)), F.lit(1 << i).cast("bigint"))
                .otherwise(F.lit(0).cast("bigint"))
                for i, (_, table, _, fails) in enumerate(checks) if table == name]
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        own = [F.col(k) if name in ("orders", home) else
               F.lit(None).cast(tables["orders"].schema[k].dataType).alias(k)
               for k, home in keys.items()]
        return tables[name].select(*own, mask.alias("_mask"), F.lit(name).alias("_table"))

    rows = part("orders").unionByName(part("users")).unionByName(part("products"))
    sets = [*keys, "_mask"]
    groups = rows.groupingSets([[s] for s in sets], *sets).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col("_table") == t).alias(f"_{t}") for t in tables])

    def within(column: str) -> Column:   # every other column of the set is summed away
        return F.col("_set") == 2 ** len(sets) - 1 - 2 ** (len(sets) - 1 - sets.index(column))

    def rows_of(condition: Column, n: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0).cast("bigint"))

    used = F.col("_orders") > 0
    out = [rows_of(within("_mask") & (F.col("_mask").bitwiseAND(1 << i) != 0), "_all").alias(f"check_{i}")
           for i in range(len(checks))]
    for k, home in keys.items():
        if home:
            lost = F.col(k).isNull() | (F.col(f"_{home}") == 0)
            out.append(rows_of(within(k) & lost, "_orders").alias(f"orphan_{k}"))
            out.append(F.count_if(within(k) & used & F.col(k).isNotNull()).alias(f"unique_{home}"))
    out.append(F.count_if(within("order_stage") & used & ~is_known_stage("order_stage"))
               .alias("unknown_stages"))
    return groups.agg(*out)


def validation_rows(checked: DataFrame, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    """The one row of :func:`check_pass` as the report."""
    found = []
    for i, (check, table, column, _) in enumerate(checks):
        n = F.col(f"check_{i}")
        if check == "not_numeric":   # one issue per column
            n = (n > 0).cast("bigint")
        found.append((check, f"{table}.{column}", n, check != "null_values"))
    found += [("orphan_key", "orders.user_id", F.col("orphan_user_id"), True),
              ("orphan_key", "orders.product_id", F.col("orphan_product_id"), True),
              ("unknown_stage", "orders.order_stage", F.col("unknown_stages"), True)]
    total = None
    for _, _, n, counted in found:
        if counted:
            total = n if total is None else total + n
    found.append(("total_issues", "all", total, True))
    rows = F.array(*[_row(c, col, n, k) for c, col, n, k in found])
    return checked.select(F.inline(rows))


def validation_report(users: DataFrame, products: DataFrame, orders: DataFrame,
                      signup_fmt: str | Sequence[str] = DATE_FORMAT,
                      order_fmt: str | Sequence[str] = TIMESTAMP_FORMAT) -> DataFrame:
    """Step-4 checks on raw-text dates, numeric columns, keys and stages, in one pass.

    Key columns of orders and dimension have the same type (or widen to one).
    """
    return validation_rows(check_pass(users, products, orders, signup_fmt, order_fmt),
                           row_checks(users, products, orders, signup_fmt, order_fmt))


def orders_profile(orders: DataFrame, date_column: str = "order_date") -> DataFrame:
    """One row: total rows, distinct users, distinct products, date range."""
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("product_id").alias("unique_products"),
        F.min(date_column).alias("first_order_date"),
        F.max(date_column).alias("last_order_date"))


def stage_mix(orders: DataFrame, column: str = "order_stage") -> DataFrame:
    """Rows per known stage and their share of *all* rows (unknown included).

    One pass of conditional counts; absent stages show 0.
    """
    return stage_rows(orders.agg(*stage_counts(column)))


def stage_counts(column: str = "order_stage") -> list[Column]:
    """``_total`` and ``_n<i>``: all rows and those of each known stage, as aggregates."""
    stage = F.col(column)
    return [F.count(F.lit(1)).alias("_total"),
            *[F.count_if(stage == s).alias(f"_n{i}") for i, s in enumerate(STAGES)]]


def stage_rows(one: DataFrame) -> DataFrame:
    """The row of :func:`stage_counts` as the stage mix."""
    rows = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step"),
                              F.lit(s).alias("order_stage"),
                              F.col(f"_n{i}").alias("n_rows"))
                     for i, s in enumerate(STAGES)])
    out = one.select("_total", F.inline(rows))
    pct = F.try_divide(F.col("n_rows").cast("double"),
                       F.col("_total").cast("double")) * F.lit(100.0)
    return out.select("step", "order_stage", "n_rows", pct.alias("pct_of_rows"))


__all__ = ["orphans", "unknown_stages", "row_checks", "check_pass", "validation_rows",
           "validation_report", "orders_profile", "stage_mix", "stage_counts", "stage_rows"]
