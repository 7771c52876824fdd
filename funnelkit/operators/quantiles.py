"""Exact quantiles with linear interpolation, computed without one big group.

``F.percentile`` keeps every distinct value of the column in one aggregation
buffer, which a global quantile over a large table cannot afford. Here:

1. equal values are counted first (``groupBy(v).count()``, partial aggregation
   map-side), so a value repeated a billion times is one row;
2. the distinct values are range-partitioned and each row is tagged with its
   range id; this table is written once with ``checkpoint()`` (the shared
   ``spark.checkpoint.dir``). Range bounds come from sampling, so two separate
   evaluations of the range shuffle may cut differently; every later step
   reads the stored ids instead, which keeps them consistent and survives a
   lost executor. Each range then sums its counts locally (a window
   partitioned by range id);
3. per-range totals (one row per range) give each range's offset;
4. every distinct value now knows its rank interval ``[start, stop)`` and the
   total count (:func:`rank_table`); the target ranks pick their values in one
   global aggregate (:func:`quantile_aggs`).

The rank table answers any number of quantile questions, including quantiles
of a prefix of the sorted values (all values up to a bound) without a second
pass. The interpolation is the one of pandas / DuckDB ``quantile_cont``: for
``pos = (m - 1) p``, ``v[floor] + (v[ceil] - v[floor]) (pos - floor)``.
NULL and NaN are skipped. An empty input gives NULL quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.session import ensure_checkpoint_dir



def _name(p: float) -> str:
    return "q_" + format(p, "g").replace(".", "_")


def rank_table(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """``(v, cnt, start, stop)``: each distinct non-NaN value and its 0-based
    rank interval among all non-NULL, non-NaN values of ``column``.

    Without ``ranges`` the range partition count is left to adaptive
    execution, which may merge small neighbouring ranges; merged ranges stay
    contiguous, so partition ids keep the value order.

    Eager: writes the tagged distinct values (one job) to the checkpoint
    folder; the returned DataFrame is lazy from there on.
    """
    ensure_checkpoint_dir(df.sparkSession)
    v = F.col(column).cast("double")
    values = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))

    ranged = (counts.repartitionByRange(ranges, "v") if ranges
              else counts.repartitionByRange("v"))
    ranged = ranged.withColumn("rid", F.spark_partition_id()).checkpoint(eager=True)
    in_range = Window.partitionBy("rid").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("cum", F.sum("cnt").over(in_range))

    # one row per range: its size, the number of values in earlier ranges and
    # the total count n (the same on every row)
    before = Window.orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (local.groupBy("rid").agg(F.max("cum").alias("size"))
               .withColumn("off", F.coalesce(F.sum("size").over(before),
                                             F.lit(0).cast("bigint")))
               .withColumn("n", F.sum("size").over(Window.partitionBy()))
               .select("rid", "off", "n"))
    # ``ranges`` rows: a proven-small broadcast side
    return (local.join(F.broadcast(offsets), "rid")
            .select("v", "cnt",
                    (F.col("off") + F.col("cum") - F.col("cnt")).alias("start"),
                    (F.col("off") + F.col("cum")).alias("stop"), "n"))


def quantile_aggs(m: Column, probs: Sequence[float],
                  names: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Aggregates over a rank table that pick the ranks of each probability in
    a population of the first ``m`` values (``m`` is the same on every row),
    and the columns that interpolate the picked values."""
    aggs, outs = [], []
    for i, p in enumerate(probs):
        pos = (m - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos).cast("bigint"), F.ceil(pos).cast("bigint")

        def at(rank: Column) -> Column:
            inside = (F.col("start") <= rank) & (rank < F.col("stop"))
            return F.max(F.when(inside, F.col("v")))

        aggs += [at(lo).alias(f"_lo{i}"), at(hi).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_f{i}")]
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
                     * F.col(f"_f{i}")).alias(names[i]))
    return aggs, outs


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float],
                    names: Sequence[str] | None = None,
                    ranges: int | None = None) -> DataFrame:
    """One-row DataFrame with one double column per probability."""
    names = list(names or [_name(p) for p in probs])
    aggs, outs = quantile_aggs(F.col("n"), probs, names)
    return rank_table(df, column, ranges).agg(*aggs).select(*outs)


def approx_quantiles(df: DataFrame, column: str, probs: Sequence[float],
                     names: Sequence[str] | None = None,
                     accuracy: int = 10000) -> DataFrame:
    """Same shape as :func:`exact_quantiles`, from ``percentile_approx``."""
    names = list(names or [_name(p) for p in probs])
    v = F.col(column).cast("double")
    arr = F.percentile_approx(F.when(~F.isnan(v), v), list(probs), accuracy)
    return df.agg(arr.alias("qs")).select(
        *[F.col("qs")[i].alias(names[i]) for i in range(len(probs))])
