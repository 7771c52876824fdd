"""Sharding by a hierarchical weighted hash tree (operator 10).

The tree has regions, racks and shards; a node weighs what the shards below it
weigh together. A row descends level by level: at each node every child draws an
exponential waiting time ``-ln(u) / weight`` from a hash of the key and the
child's path, and the smallest draw wins. So a row computes the draws of the
children on its way only, and each level is a weighted choice.

A heavier shard makes its rack and its region heavier, and nothing else: other
draws stay, so rows only move into that region, and inside it only into that
rack, and there only into that shard. A region, rack or shard added beside others
takes rows from its siblings without moving any between them. In particular one
more shard that opens a region of its own, as the 41st of ``uniform_tree`` does,
takes rows only into itself (law ``key``: doc_id and the number of shards
decide); one that joins a region with others also draws rows to its neighbours
there. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.shared import stage


@dataclass(frozen=True)
class Leaf:
    """A shard's place in the tree."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def uniform_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards of weight 1 in racks of ``per_rack`` and regions of ``racks`` racks."""
    return [Leaf(s, s // (per_rack * racks), s // per_rack) for s in range(shards)]


def _choice(key: Column, path: tuple[int, ...], children: dict[int, float]) -> Column:
    """The child of the node at ``path`` that ``key`` falls into, by weight."""
    def draw(child: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, *map(F.lit, (len(path), *path, child))), 11)
        wait = -F.log((bits + F.lit(0.5)) / F.lit(2.0**53)) / F.lit(float(weight))
        return F.struct(wait.alias("draw"), F.lit(child).alias("child"))
    draws = [draw(c, w) for c, w in children.items()]
    return F.least(*draws)["child"] if len(draws) > 1 else F.lit(next(iter(children)))


def descend(rows: DataFrame, key: Column, tree: list[Leaf], prefix: str = "") -> DataFrame:
    """``rows`` with the columns region, rack and shard (each with ``prefix``) of ``key``'s place."""
    live = [x for x in tree if x.weight > 0]
    if not live or len({x.shard for x in tree}) != len(tree):
        raise ValueError("a tree needs a positive weight and distinct shards")
    below: dict[tuple[int, ...], dict[int, float]] = {}
    for leaf in live:
        way = (leaf.region, leaf.rack, leaf.shard)
        for depth in range(3):
            node = below.setdefault(way[:depth], {})
            node[way[depth]] = node.get(way[depth], 0.0) + leaf.weight
    names = [f"{prefix}{n}" for n in ("region", "rack", "shard")]
    rows = rows.withColumn(names[0], _choice(key, (), below[()]))
    for depth in (1, 2):
        choice = None
        for path, children in below.items():
            if len(path) == depth:
                here = F.col(names[0]) == path[0]
                if depth == 2:
                    here &= F.col(names[1]) == path[1]
                pick = _choice(key, path, children)
                choice = F.when(here, pick) if choice is None else choice.when(here, pick)
        rows = rows.withColumn(names[depth], choice)
    return rows


def shard_documents(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None
                    ) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot and grown_shard per row of ``docs``.

    ``size`` is the text's UTF-8 bytes (NULL: none) plus 16, ``text_crc32`` its
    unsigned CRC-32 (NULL as the empty text). ``slot`` numbers the rows of a
    shard from 0 without gaps: hash buckets (about sqrt(rows) a shard) in order,
    rows by doc_id inside, so no shard is sorted as a whole. Rows with equal
    doc_ids, or with none, share a shard but have slots of their own.
    ``grown_shard`` is the shard in the tree ``grown`` (NULL without one). An
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long")
                       .alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = descend(rows, F.col("doc_id"), tree)
    if grown:
        rows = descend(rows, F.col("doc_id"), grown, "grown_")
    else:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = stage(rows.drop("grown_region", "grown_rack"), "places")
    buckets = max(1, int((rows.count() / len(tree)) ** 0.5))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(buckets))
    rows = rows.withColumn("bucket", bucket)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
              .select("shard", "bucket",
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("nth", F.row_number().over(inside))
            .join(starts, ["shard", "bucket"])
            .withColumn("slot", (F.col("ahead") + F.col("nth") - 1).cast("long"))
            .select("doc_id", "size", "text_crc32", "region", "rack", "shard", "slot",
                    "grown_shard"))


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over all ``documents``: 40 shards, law ``key``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = shard_documents(docs, uniform_tree(40), uniform_tree(41))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                        "slot", "grown_shard", "region", "rack")
