"""Merkle dataset manifest with bitmap-rank leaf coordinates (operator 12).

Leaves of a group (language) ascend by doc_id, but they are never sorted.
A leaf's coordinate is the rank of its doc_id in the group's bitmap:

* **Bitmaps.** doc_id ``d`` is bit ``d & 63`` of word ``d >> 6``. Only words with
  a bit set are rows, and partial words merge with ``bit_or``, map-side first.
  A doc_id on several rows is written in slices: slice j holds the ids whose row
  count has bit j, and counts ``2**j`` times.
* **Popcount directory.** ``bit_count`` weighs the words; weights are summed
  ahead of each word in four steps (word in block of 2**10, block in 2**16,
  those in 2**16, those in the group), so no step orders more than 65,536 rows
  of one key whatever the ids are.
* **Rank query.** A leaf joins its word: coordinate = weight ahead of the word +
  popcount of the bits below its own. Rows that share a doc_id follow by leaf
  hash; equal rows take consecutive slots.

The tree is then reduced by keyed slot arrays: nodes are dealt by (group,
slot div 1024), placed in an array by slot and reduced ten levels at once, until
a group has one node. Going back down, each array meets the path of its own
node and yields the path of every member.

Defined results: a NULL lang is the first group, a NULL doc_id the first leaf of
its group (never forged); NULL fields are ``-``; an empty table gives no rows;
other columns are not read. Each text is hashed once, in the scan.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from funnelkit.llm.shared import stage

#: nodes of one slot array, at most
ARRAY = 1024
#: copies of one row that are dealt out together
SPAN = 1 << 16
#: siblings on the way up: the node's place in its run, the others' digests
PATH = pa.list_(pa.struct([("pos", pa.int32()), ("others", pa.string())]))
PATH_DDL = "path array<struct<pos:int,others:string>>, subroot string, root string"


# ------------------------------------------------------------------ leaves

def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """sha256 (hex) of the fields, each ``-`` or its UTF-8 length, ``:`` and value."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def group_key(group: Column) -> Column:
    """A key that orders like ``group``, NULL first, and is never NULL."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


# ------------------------------------------------------------------ ranks

def _ahead(table: DataFrame, keys: list[str], order: str) -> Column:
    over = Window.partitionBy(*keys).orderBy(order)
    return F.sum("weight").over(over) - F.col("weight")


def _word(doc_id: Column) -> Column:
    """The bitmap word of an id; NULL comes before every id."""
    return F.coalesce(F.shiftright(doc_id, 6), F.lit(-(1 << 57) - 1))


def _bit(doc_id: Column) -> Column:
    return F.coalesce(doc_id.bitwiseAND(63), F.lit(0)).cast("int")


def popcount_directory(rows: DataFrame) -> DataFrame:
    """``grp, word, slices, base, n`` from rows with ``grp`` and ``doc_id``.

    ``slices`` are the word's bits by slice, ``base`` the rows ahead of the word,
    ``n`` the rows of the group.
    """
    ids = rows.groupBy("grp", "doc_id").agg(F.count("*").alias("c"))
    of = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.filter(
        F.sequence(F.lit(0), F.lit(62)),
        lambda j: F.call_function("shiftright", F.col("c"), j).bitwiseAND(1) == 1))
    bits = (ids.select("grp", _word(F.col("doc_id")).alias("word"),
                       F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("doc_id")))
                       .alias("mask"), F.explode(of).alias("slice"))
            .groupBy("grp", "word", "slice").agg(F.bit_or("mask").alias("bits")))
    weight = F.sum(F.call_function("shiftleft", F.bit_count("bits").cast("long"), F.col("slice")))
    words = stage(
        bits.groupBy("grp", "word").agg(
            F.collect_list(F.struct("slice", "bits")).alias("slices"), weight.alias("weight"))
        .withColumn("block", F.shiftright("word", 10))
        .withColumn("in_block", _ahead(None, ["grp", "block"], "word")), "bitmap-words")
    blocks = words.groupBy("grp", "block").agg(F.sum("weight").alias("weight")).select(
        "*", F.shiftright("block", 16).alias("super"))
    blocks = stage(blocks.withColumn("in_super", _ahead(None, ["grp", "super"], "block")), "blocks")
    supers = (blocks.groupBy("grp", "super").agg(F.sum("weight").alias("weight"))
              .withColumn("top", F.shiftright("super", 16))
              .withColumn("in_top", _ahead(None, ["grp", "top"], "super")))
    tops = (supers.groupBy("grp", "top").agg(F.sum("weight").alias("weight"))
            .withColumn("in_group", _ahead(None, ["grp"], "top"))
            .withColumn("n", F.sum("weight").over(Window.partitionBy("grp"))))
    upper = supers.drop("weight").join(tops.drop("weight"), ["grp", "top"]).select(
        "grp", "super", (F.col("in_top") + F.col("in_group")).alias("in_top"), "n")
    upper = blocks.drop("weight").join(upper, ["grp", "super"]).select(
        "grp", "block", (F.col("in_super") + F.col("in_top")).alias("ahead"), "n")
    return words.drop("weight").join(upper, ["grp", "block"]).select(
        "grp", "word", "slices", (F.col("in_block") + F.col("ahead")).alias("base"), "n")


def _ties(copies: DataFrame) -> DataFrame:
    """``tie``: rows of the same id with a smaller leaf, in two steps by leaf prefix."""
    key = ["grp", "doc_id", "pre"]
    copies = copies.withColumn("pre", F.substring("leaf", 1, 3))
    parts = (copies.groupBy(*key).agg(F.sum("c").alias("weight"))
             .withColumn("before", _ahead(None, ["grp", "doc_id"], "pre")).drop("weight"))
    within = copies.withColumn("weight", F.col("c")).withColumn(
        "within", _ahead(None, key, "leaf"))
    same = [within[k].eqNullSafe(parts[k]) for k in key]
    return within.join(parts, same).select(
        *[within[c] for c in copies.columns if c != "pre"],
        (F.col("within") + F.col("before")).alias("tie"))


def leaf_slots(rows: DataFrame) -> DataFrame:
    """``grp, doc_id, leaf, forged, slot, n`` from stored rows with the first four."""
    directory = popcount_directory(rows)
    copies = rows.groupBy("grp", "doc_id", "leaf").agg(F.min("forged").alias("forged"),
                                                       F.count("*").alias("c"))
    repeated = rows.groupBy("grp", "doc_id").count().where("count > 1")
    copies = (copies.withColumn("tie", F.lit(0).cast("long")) if repeated.isEmpty()
              else _ties(copies))
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit")))
    rank = F.aggregate("slices", F.lit(0).cast("long"), lambda acc, s: acc + F.call_function(
        "shiftleft", F.bit_count(s["bits"].bitwiseAND(F.col("below"))).cast("long"), s["slice"]))
    placed = (copies.withColumn("word", _word(F.col("doc_id")))
              .withColumn("bit", _bit(F.col("doc_id"))).withColumn("below", below)
              .join(directory, ["grp", "word"])
              .withColumn("first", F.col("base") + rank + F.col("tie")))
    last = F.col("c") - 1
    some = placed.where(F.col("c") <= SPAN).withColumn("from", F.lit(0).cast("long"))
    many = placed.where(F.col("c") > SPAN).withColumn(
        "from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(SPAN).cast("long"))))
    spans = some.unionByName(many.repartition("grp", "leaf", "from"))
    copy = F.explode(F.sequence("from", F.least(last, F.col("from") + (SPAN - 1))))
    return spans.withColumn("copy", copy).select(
        "grp", "doc_id", "leaf", "forged", (F.col("first") + F.col("copy")).alias("slot"), "n")


# ------------------------------------------------------------------ the tree

def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _height(fanout: int) -> int:
    height = 1
    while fanout ** (height + 1) <= ARRAY:
        height += 1
    return height


def _array(table: pa.Table, fanout: int, height: int) -> tuple[list[int], list[list[str]]]:
    """(places, levels): the table's nodes by slot, and what they reduce to."""
    size = fanout ** height
    places = [s % size for s in table.column("slot").to_pylist()]
    nodes = [""] * len(places)
    for place, node in zip(places, table.column("node").to_pylist(), strict=True):
        nodes[place] = node
    levels = [nodes]
    alone = table.column("n")[0].as_py() <= size   # the group's only array: up to one node
    while len(levels[-1]) > 1 if alone else len(levels) <= height:
        below = levels[-1]
        levels.append([_hash("".join(below[i:i + fanout])) for i in range(0, len(below), fanout)])
    return places, levels


def _reducer(fanout: int):
    height = _height(fanout)
    size = fanout ** height

    def reduce(table: pa.Table) -> pa.Table:
        _, levels = _array(table, fanout, height)
        n = table.column("n")[0].as_py()
        return pa.table({"grp": table.column("grp")[:1], "slot": table.column("block")[:1],
                         "node": [levels[-1][0]], "n": pa.array([-(-n // size)], pa.int64())})
    return reduce


def _guide(fanout: int):
    height = _height(fanout)

    def paths(table: pa.Table, above: pa.Table) -> pa.Table:
        places, levels = _array(table, fanout, height)
        head = above.column("path")[0].as_py()
        pos, others, ends = [], [], [0]
        for place in places:
            for level in levels[:-1]:
                own = place % fanout
                run = level[place - own:place - own + fanout]
                pos.append(own)
                others.append("".join(run[:own] + run[own + 1:]))
                place //= fanout
            pos += [s["pos"] for s in head]
            others += [s["others"] for s in head]
            ends.append(len(pos))
        steps = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(others, pa.string())],
                                           fields=list(PATH.value_type))
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
        out = table.drop_columns(["block"]).append_column("path", path)
        for name in ("subroot", "root"):
            value = above.column(name)[0].as_py()
            out = out.append_column(name, pa.array([value] * len(places), pa.string()))
        return out
    return paths


def _blocked(nodes: DataFrame, fanout: int) -> DataFrame:
    size = fanout ** _height(fanout)
    return nodes.withColumn("block", F.floor(F.col("slot") / F.lit(size)).cast("long"))


def climb(nodes: DataFrame, largest: int, fanout: int) -> list[DataFrame]:
    """``nodes`` (grp, slot, node, n) and its reductions, the last with one node a group."""
    levels, size = [nodes], fanout ** _height(fanout)
    while largest > 1:
        up = _blocked(levels[-1].select("grp", "slot", "node", "n"), fanout).groupBy(
            "grp", "block").applyInArrow(_reducer(fanout), "grp string, slot long, node string, n long")
        levels.append(stage(up, "nodes"))
        largest = -(-largest // size)
    return levels


def descend(levels: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """The rows of ``levels[0]`` with path, subroot and root; ``top`` has those of each group."""
    for depth in range(len(levels) - 2, -1, -1):
        below = _blocked(levels[depth], fanout)
        schema = StructType([f for f in below.schema if f.name != "block"]
                            + StructType.fromDDL(PATH_DDL).fields)
        above = top.select("grp", F.col("slot").alias("block"), "path", "subroot", "root")
        top = below.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(
            _guide(fanout), schema)
        if depth:
            top = stage(top.drop("node", "n"), "paths")
    return top


def manifest(docs: DataFrame, leaf: Column, forged: Column | None = None, group: str = "lang",
             fanout: int = 2) -> DataFrame:
    """``grp, doc_id, leaf, forged, slot, path, subroot, root``, one row per row of ``docs``.

    ``leaf`` hashes a row, ``forged`` a changed one (default: as it is). Each
    ``fanout`` consecutive nodes become one, within a group up to its subroot, and
    the subroots, in group order, up to the root. ``path`` leads from a leaf to the
    root: its place in each run and the digests of the run's other nodes, joined.
    """
    if not 2 <= fanout <= ARRAY:
        raise ValueError(f"fanout must be from 2 to {ARRAY}")
    rows = stage(docs.select(group_key(F.col(group)).alias("grp"),
                             F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
                             (leaf if forged is None else forged).alias("forged")), "leaves")
    leaves = stage(leaf_slots(rows).withColumn("node", F.col("leaf")), "slots")
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels = climb(leaves, largest, fanout)
    # one row per group from here to the root
    groups = levels[-1].select("grp", "node")
    if len(levels) == 1:
        groups = stage(groups, "subroots")
    n = groups.count()
    order = Window.orderBy("grp")
    crown = stage(groups.select(
        F.lit("").alias("grp"), (F.row_number().over(order) - 1).cast("long").alias("slot"), "node",
        F.lit(n).cast("long").alias("n"), F.col("grp").alias("group")), "crown")
    tops = climb(crown, n, fanout)
    bare = F.lit(None).cast("array<struct<pos:int,others:string>>")
    root = tops[-1].select("grp", "slot", F.coalesce(bare, F.array()).alias("path"),
                           F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    if len(tops) == 1:
        root = crown.select("group", "node", F.coalesce(bare, F.array()).alias("path"),
                            F.col("node").alias("root"))
    else:
        root = descend(tops, root, fanout)
    above = root.select(F.col("group").alias("grp"), F.lit(0).cast("long").alias("slot"), "path",
                        F.col("node").alias("subroot"), "root")
    if len(levels) == 1:   # every group is a lone leaf
        return leaves.drop("node", "n").join(above.drop("slot"), "grp")
    return descend(levels, stage(above, "subroots"), fanout).drop("node", "n")


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings on the path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["others"]), ""), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` and the siblings of ``path`` give."""
    def up(acc: Column, s: Column) -> Column:
        ahead = s["pos"] * 64
        return F.sha2(F.concat(F.substring(s["others"], F.lit(1), ahead), acc,
                               F.substring(s["others"], ahead + 1, F.length(s["others"]))), 256)
    return F.aggregate(path, node, up)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 12 over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(hit & F.col("n_chars").isNotNull(), leaf_hash(*fields[:3], more, fields[4]))
    made = manifest(docs, leaf_hash(*fields), F.coalesce(changed, leaf_hash(*fields)))
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path"))
                      .alias("proof_sha256"), fold(F.col("forged"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_TREE_SQL = """
  SELECT {key}, 0 AS lvl, {slot} AS i, {node} AS h FROM {table}
  UNION ALL
  SELECT {key}, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS m FROM {name}) WHERE m > 1
  GROUP BY {key}, lvl, i // 2"""

OP12_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN xor(list_reduce(
                list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)),
                CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0
              THEN {_leaf_sql('(n_chars + 1)')} END AS changed
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot,
         row_number() OVER () AS id, coalesce(changed, leaf) AS given FROM hashed),
nodes(grp, lvl, i, h) AS ({_TREE_SQL.format(key='grp', slot='slot', node='leaf', table='leaves',
                                            name='nodes')}),
subs AS (SELECT grp, arg_max(h, lvl) AS subroot, max(lvl) AS height FROM nodes GROUP BY grp),
ranked AS (SELECT *, '' AS one, row_number() OVER (ORDER BY grp) - 1 AS place FROM subs),
crown(one, lvl, i, h) AS ({_TREE_SQL.format(key='one', slot='place', node='subroot', table='ranked',
                                            name='crown')}),
top AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS height FROM crown),
sides AS (
  SELECT id, l.slot >> lvl & 1 AS pos, lvl, h FROM leaves l JOIN nodes n
    ON n.grp = l.grp AND n.i = xor(l.slot >> n.lvl, 1)
  UNION ALL
  SELECT id, r.place >> lvl & 1, s.height + lvl, h FROM leaves l JOIN subs s USING (grp)
    JOIN ranked r USING (grp) JOIN crown n ON n.i = xor(r.place >> n.lvl, 1)),
proofs AS (SELECT id, string_agg(h, '' ORDER BY lvl) AS proof FROM sides GROUP BY id),
climb(id, lvl, h, height) AS (
  SELECT id, 0, given, s.height + top.height FROM leaves JOIN subs s USING (grp), top
  UNION ALL
  SELECT c.id, c.lvl + 1, sha256(CASE WHEN s.pos = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END),
         c.height
  FROM climb c LEFT JOIN sides s ON s.id = c.id AND s.lvl = c.lvl WHERE c.lvl < c.height),
folded AS (SELECT id, h AS folded_root FROM climb WHERE lvl = height)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM leaves JOIN subs USING (grp) JOIN folded USING (id) LEFT JOIN proofs USING (id), top
"""
