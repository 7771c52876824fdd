"""Mixing sources to target weights by Pareto order sampling (operator 1).

Targets: sources in code-point order (NULL last) take the weights in turn and
share the total size in proportion. A target above ``cap`` times its source's
size stops there; the excess goes to the others by weight until none is above.

Sampling: with ``m = target / size`` every document is taken ``floor(m)`` times
for certain. The rest of the target, a part ``f = m - floor(m)`` of the source,
is a Pareto order sample: documents rank by their random odds ``u / (1 - u)``
over their inclusion odds ``odds * f / (1 - f)`` and enter by rank until the
words are used up, so the sample's size in words is fixed. Random numbers are
hashes of seed, id and text: reruns agree.

No source is sorted as a whole. Ranks fall into about ``sqrt(n)`` ranges per
source; sums per range find the range in which the words run out. Ranges before
it enter whole; that one alone (about ``sqrt(n)`` documents) is walked in rank
order, where a document that no longer fits is passed over for the next that
does. The words still missing then go on through the later ranges in the same
way, counting only documents that fit, until no later one does. So every
document left out is longer than the words that the source misses.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.shared import sized, stage

STEPS = "array<struct<edge:long,left:double,limit:double,missing:double>>"
WEIGHTS = (5.0, 2.0, 1.0)
BLANKS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs without blanks (U+0020, U+0009 to U+000D); NULL counts 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(
        F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def _targets(base: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: key, source_size, n, target, whole copies, the rest, usual odds.

    Sources stop at their limits in the order of limit to weight. After the first
    k the others share what is left by weight at some level; the first k whose
    level stays below the next ratio gives the targets.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))  # over one row per source
    turn = (F.row_number().over(order) - 1) % len(weights)
    sources = (
        base.groupBy("key", "source").agg(
            F.sum("size").alias("source_size"), F.count("*").alias("n"),
            F.exp(F.avg(F.ln("odds"))).alias("usual"))
        .withColumn("weight", F.array(*map(F.lit, map(float, weights)))[turn.cast("int")])
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight")))
    upto = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    sources = sources.withColumn("level", (
        F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / free)
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level")))
                       .over(every)["level"], F.max("ratio").over(every))
    target = F.least(F.col("limit"), level * F.col("weight"))
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    return stage(sources.withColumn("target", target).withColumn("whole", whole).select(
        "key", "source_size", "n", "target", "whole", "usual",
        F.greatest(F.col("target") - F.col("whole") * size, F.lit(0.0)).alias("rest")), "targets")


def _ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's figures, and rank and cell where they are drawn.

    Cells cut the rank evenly on the scale on which a document of its source's
    usual odds (their geometric mean) is uniform, whatever part is drawn.
    """
    part = F.col("rest") / F.col("source_size")
    chance = F.col("u") / (1 - F.col("u"))
    drawn = (F.col("size") > 0) & (F.col("rest") > 0)
    near = chance / F.col("odds") * F.col("usual")
    cells = F.greatest(F.lit(1), F.floor(F.sqrt("n")))
    return (rows.join(sized(sources), "key")
            .withColumn("rank", F.when(drawn, chance / (F.col("odds") * part / (1 - part))))
            .withColumn("cell", F.when(drawn, F.floor(near / (1 + near) * cells))))


def _take(table: pa.Table) -> tuple[pa.Table, list[int], float]:
    """(documents of one range in rank order, copies of each that enter, words still missing)."""
    table = table.sort_by([("rank", "ascending"), ("size", "ascending")])
    left = table.column("left")[0].as_py()
    picked = []
    for size, c in zip(table.column("size").to_pylist(), table.column("c").to_pylist(), strict=True):
        picked.append(min(c, int(left // size)))
        left -= size * picked[-1]
    return table, picked, left


def _left(table: pa.Table) -> pa.Table:
    """The step of one source: its range, the words missing before it and after it."""
    _, _, limit = _take(table)
    return table.select(["key", "edge", "left"]).slice(0, 1).append_column(
        "limit", pa.array([limit], pa.float64()))


def _walk(table: pa.Table) -> pa.Table:
    """What enters of each (rank, size) in a range where a source's words run out."""
    table, picked, _ = _take(table)
    missing = table.column("missing")[0].as_py()  # in the source's last such range, else NULL
    sizes, count = table.column("size").to_pylist(), table.column("c").to_pylist()
    spare = min(((s, i) for i, s in enumerate(sizes) if picked[i] < count[i]), default=None)
    if spare and missing is not None and spare[0] - missing < missing:  # overshooting is nearer
        picked[spare[1]] += 1
    return table.select(["key", "cell", "rank", "size", "c"]).append_column(
        "picked", pa.array(picked, pa.int64()))


def _front(rows: DataFrame) -> DataFrame:
    """Per source: its words, the first range that the missing words do not cover, what is left there."""
    upto = Window.partitionBy("key").orderBy("cell")
    short = F.col("through") > F.col("left")
    ahead = F.struct("cell", (F.col("left") - F.col("through") + F.col("words")).alias("left"))
    return stage(rows.groupBy("key", "cell")
                 .agg(F.sum(F.col("size") * F.col("c")).alias("words"), F.max("left").alias("left"))
                 .withColumn("through", F.sum("words").over(upto))
                 .groupBy("key").agg(F.max("left").alias("before"), F.sum("words").alias("words"),
                                     F.min(F.when(short, ahead)).alias("at"))
                 .select("key", "words", "before", F.col("at.cell").alias("edge"),
                         F.col("at.left").alias("left")), "front")


def _paths(rows: DataFrame) -> DataFrame:
    """Per source its ``steps`` by range: edge, words left before it, limit after it, missing.

    ``rows`` is stored: key, cell, rank, size, c, left. Between two edges every
    document of at most ``limit`` words enters. ``missing`` (last step only) is
    what the source lacks in the end. Each round is three small stored tables and
    keeps only the documents that still fit, seldom more than a few.
    """
    steps, ends, front = [], [], _front(rows)
    while not (edges := front.where("edge IS NOT NULL").select("key", "edge", "left")).isEmpty():
        step = stage(rows.drop("left").join(sized(edges), "key").where("cell = edge")
                     .select("key", "edge", "rank", "size", "c", "left").groupBy("key")
                     .applyInArrow(_left, "key string, edge long, left double, limit double"), "steps")
        steps.append(step)
        rows = stage(rows.drop("left").join(sized(step.drop("left")), "key")
                     .where("cell > edge AND size <= limit")
                     .select("key", "cell", "rank", "size", "c", F.col("limit").alias("left")), "ranks")
        front = _front(rows)
        # a source that goes no further lacks what its fitting rest does not give
        ends.append(step.join(front, "key", "left").where(front["edge"].isNull()).select(
            "key", step["edge"], (F.col("limit") - F.coalesce("words", F.lit(0))).alias("missing")))
    if not steps:
        return front.limit(0).select("key", F.lit(None).cast(STEPS).alias("steps"))
    every, last = reduce(DataFrame.unionByName, steps), reduce(DataFrame.unionByName, ends)
    return stage(every.join(last, ["key", "edge"], "left")
                 .groupBy("key").agg(F.sort_array(F.collect_list(
                     F.struct("edge", "left", "limit", "missing"))).alias("steps")), "paths")


def _decisions(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Per (key, cell, rank, size) in a range where words run out: how many of ``c`` enter."""
    at = rows.drop("left").join(sized(paths.select("key", F.explode("steps").alias("s"))
                                      .select("key", "s.*")), "key").where("cell = edge")
    return stage(at.select("key", "cell", "rank", "size", "c", "left", "missing")
                 .groupBy("key", "cell").applyInArrow(
                     _walk, "key string, cell long, rank double, size long, c long, picked long"),
                 "picked")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0,
                odds: str | None = None, seed: int = 20260101, keep_text: bool = True
                ) -> DataFrame:
    """``row`` (struct of the columns of ``docs``), size, source_size, target, copies.

    ``docs`` has ``doc_id``, ``text`` and ``source``. ``odds`` names a column of
    relative inclusion odds (missing or not positive: 1). A document's size is
    its word count, 0 for NULL, empty and blank texts, which are never drawn
    (copies 0). A NULL source is a source of its own. Repeated rows are drawn
    one by one. An empty table gives an empty mix. ``copies`` never exceeds
    ``cap``, an integer of at least 1. Without ``keep_text`` the row struct
    holds only doc_id and source. Texts stay where they were read but for those
    of the few ranges in which words run out.
    """
    if cap < 1 or cap != int(cap) or not weights or min(weights) <= 0:
        raise ValueError("cap must be a whole number from 1 on, weights positive")
    text = F.col("text").cast("string")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), text), 11)
    given = F.col(odds).cast("double") if odds else F.lit(1.0)
    row = F.struct("*") if keep_text else F.struct("doc_id", "source")
    base = docs.select(
        row.alias("row"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        word_count(text).alias("size"), ((bits + F.lit(0.5)) / F.lit(2.0**53)).alias("u"),
        F.when(given > 0, given).otherwise(1.0).alias("odds"))
    narrow = stage(base.drop("row") if keep_text else base, "sizes")
    base = base if keep_text else narrow
    sources = _targets(narrow, weights, cap)
    rows = stage(_ranked(narrow.select("key", "size", "u", "odds"), sources)
                 .where("cell IS NOT NULL").groupBy("key", "cell", "rank", "size")
                 .agg(F.count("*").alias("c"), F.max("rest").alias("left")), "ranks")
    paths = _paths(rows)
    chosen = _decisions(rows, paths)
    figures = stage(sources.join(paths, "key", "left"), "sources")
    placed = _ranked(base.drop("source"), figures).withColumn("step", F.try_element_at(
        F.filter("steps", lambda e: e["edge"] <= F.col("cell")), F.lit(-1)))
    placed = placed.select("row", "key", "cell", "rank", "size", "source_size", "target", "whole",
                           "step")
    at_edge = F.coalesce(F.col("cell") == F.col("step.edge"), F.lit(False))
    extra = F.when(F.col("cell").isNotNull() & F.coalesce(
        F.col("size") <= F.col("step.limit"), F.lit(True)), 1).otherwise(0)

    def out(extra: Column) -> list[Column]:
        copies = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0)
        return [F.col("row"), F.col("size"), F.col("source_size"), F.col("target"),
                copies.cast("long").alias("copies")]
    plain = placed.where(~at_edge).select(*out(extra))
    # equal rows share a decision; where only some of them enter, the first ones do
    same = Window.partitionBy("key", "cell", "rank", "size").orderBy(F.lit(0))
    walked = placed.where(at_edge).join(chosen, ["key", "cell", "rank", "size"])
    clear = walked.where("picked IN (0, c)").select(*out(F.when(F.col("picked") > 0, 1).otherwise(0)))
    split = walked.where("picked NOT IN (0, c)").withColumn("i", F.row_number().over(same)).select(
        *out(F.when(F.col("i") <= F.col("picked"), 1).otherwise(0)))
    return plain.union(clear).union(split)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0,
                    seed: int = 20260101) -> DataFrame:
    """``docs`` as mixed: each row as many times as the mix takes it."""
    mix = mix_sources(docs, weights, cap, seed=seed).where("copies > 0")
    return mix.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *[F.col("row")[c].alias(c) for c in docs.columns])


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, keep_text=False).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies",
        F.col("row.source").alias("source"))
