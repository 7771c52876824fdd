"""Connected components by alternating large-star and small-star steps.

Both steps only need, per node, its smallest neighbour: a minimum with map-side
combining and a join back (whose skewed keys adaptive execution splits), so a
node with very many neighbours never gathers them in one task. Each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.shared import stage


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; root is the smallest node.

    Columns are longs; loops and repeated edges are allowed, NULL ends are
    ignored. An empty input gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    stars = stage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                  .where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    seen = _digest(stars)
    for _ in range(rounds):
        if not seen[0]:
            break
        ends = stars.select(a.alias("u"), b.alias("v")).union(
            stars.select(b.alias("u"), a.alias("v")))
        low = ends.groupBy("u").agg(F.min("v").alias("m"))
        large = (ends.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where(b != F.col("m"))
                 .select(b.alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        stars = stage(small, "stars")
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = stars.select(b.alias("node"), b.alias("root")).distinct()
    return stars.select(a.alias("node"), b.alias("root")).union(roots)
