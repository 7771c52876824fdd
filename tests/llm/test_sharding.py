import collections
import math
import struct
import zlib

import pytest
import xxhash

from funnelkit.llm import sharding as sh


def test_contract(spark):
    texts = [None, "", "é" * 5, "same", "same"]
    rows = [(i, texts[i % 5]) for i in range(4000)] + [(None, "x"), (None, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sh.shard_documents(df, sh.uniform_tree(40), sh.uniform_tree(41)).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted(
        (d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, place = collections.defaultdict(list), {}
    for r in out:
        assert r.region == r.shard // 8 and r.rack == r.shard // 4
        assert r.grown_shard in (r.shard, 40)
        assert place.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(len(s) - 100) < 5 * math.sqrt(100) for s in slots.values())
    moved = sum(r.grown_shard == 40 for r in out)
    assert abs(moved - 4004 / 41) < 5 * math.sqrt(98)
    again = sh.shard_documents(df.repartition(2), sh.uniform_tree(40), sh.uniform_tree(41)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def place(key, tree):
    """A plain descent: xxhash64 of key, depth, path and child, level by level."""
    def draw(path, child, weight):
        h = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        for x in (len(path), *path, child):
            h = xxhash.xxh64(struct.pack("<i", x), seed=h).intdigest()
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight
    path = ()
    for depth in range(3):
        weights = collections.Counter()
        for x in tree:
            way = (x.region, x.rack, x.shard)
            if way[:depth] == path and x.weight > 0:
                weights[way[depth]] += x.weight
        path += (min(weights, key=lambda c: draw(path, c, weights[c])),)
    return path


TREE = [sh.Leaf(0, 0, 0, 1.0), sh.Leaf(1, 0, 0, 3.0), sh.Leaf(2, 0, 1, 2.0), sh.Leaf(3, 1, 2, 2.0),
        sh.Leaf(4, 1, 2, 1.0), sh.Leaf(5, 2, 0, 1.0), sh.Leaf(6, 2, 0, 0.0)]


def places(spark, tree, n=6000):
    df = sh.descend(spark.range(n), sh.F.col("id"), tree)
    return {r.id: (r.region, r.rack, r.shard) for r in df.collect()}


def test_equals_plain_descent(spark):
    got = places(spark, TREE, 1500)
    assert got == {i: place(i, TREE) for i in range(1500)}
    null = spark.createDataFrame([(None,)], "id long")
    [row] = sh.descend(null, sh.F.col("id"), TREE).collect()
    assert tuple(row)[1:] == place(None, TREE)
    big = sh.uniform_tree(41)
    assert places(spark, big, 300) == {i: place(i, big) for i in range(300)}


def test_weights_at_every_level(spark):
    n = collections.Counter(p[2] for p in places(spark, TREE, 20000).values())
    assert [n[i] / 2000 for i in range(7)] == pytest.approx([1, 3, 2, 2, 1, 1, 0], rel=0.1)
    with pytest.raises(ValueError):
        sh.descend(spark.range(1), sh.F.col("id"), [])


@pytest.mark.parametrize("shard", range(6))
@pytest.mark.parametrize("factor", [0.25, 3.0])
def test_movement_stays_in_the_changed_subtrees(spark, shard, factor):
    changed = [sh.Leaf(x.shard, x.region, x.rack, x.weight * factor) if x.shard == shard else x for x in TREE]
    way = next((x.region, x.rack, x.shard) for x in TREE if x.shard == shard)
    old, new = places(spark, TREE), places(spark, changed)
    moved = 0
    for i in old:
        a, b = (old[i], new[i]) if factor > 1 else (new[i], old[i])
        if a != b:   # at the level where they part, the one side goes down the changed node
            depth = next(d for d in range(3) if a[d] != b[d])
            assert b[:depth + 1] == way[:depth + 1]
            moved += 1
    assert 0 < moved < len(old) / 2


def test_added_and_removed_nodes_move_no_row_between_others(spark):
    for extra in (sh.Leaf(9, 7, 7, 2.0), sh.Leaf(9, 7, 0, 0.5)):
        old, new = places(spark, TREE), places(spark, [*TREE, extra])
        assert {new[i] for i in old if old[i] != new[i]} == {(7, extra.rack, 9)}
    old, new = places(spark, sh.uniform_tree(40)), places(spark, sh.uniform_tree(41))
    assert {new[i][2] for i in old if old[i] != new[i]} == {40}


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, shard string, slot int")
    assert sh.shard_documents(df, sh.uniform_tree(3)).collect() == []
    long = spark.createDataFrame([(1, "é" * 3_000_000)], "doc_id long, text string")
    assert sh.shard_documents(long, sh.uniform_tree(3)).first()["size"] == 6_000_016
    df = spark.createDataFrame([(1, "a", "x", 1)], "doc_id long, text string, shard string, slot int")
    assert [(r.doc_id, r.size, r.slot, r.grown_shard) for r in
            sh.shard_documents(df, sh.uniform_tree(1)).collect()] == [(1, 17, 0, None)]
