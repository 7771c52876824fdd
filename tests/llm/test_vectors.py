import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelkit.llm import embed_dedup as ed
from funnelkit.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def cluster_rows(seed, n=260, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(14, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(14)] + rng.normal(size=d) * rng.choice([0.05, 0.2, 0.28, 2])
        rows.append((i * 7 % 1009, [float(x) for x in v * rng.choice([1e-3, 1, 50])], int(rng.integers(3))))
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 1), (3001, [0.0] * d, 1), (3002, [nan] + [1.0] * (d - 1), 1),
             (3003, [inf] + [1.0] * (d - 1), 1), (3004, [None] + [1.0] * (d - 1), 1), (3005, [], 1),
             (3006, rows[3][1], None), (3007, rows[3][1][:5], rows[3][2]), (3008, rows[3][1][:5], rows[3][2]),
             rows[9], rows[9], (None, rows[9][1], rows[9][2]), (3009, [-0.0, 1.0], 2), (3010, [0.0, 2.0], 2),
             (3011, rows[4][1], rows[4][2])]
    return rows


def brute_groups(rows, t=0.93):
    def ok(v, label):
        return (v is not None and label is not None and len(v) > 0 and all(
            x is not None and math.isfinite(x) for x in v) and any(v))
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if ok(a, la) and ok(b, lb) and la == lb and len(a) == len(b):
                a, b = np.array(a), np.array(b)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= t:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    out = []
    for i, (v, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root(j) == root(i) and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((v, links[i], low, v == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [1024, 16])
def test_groups_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ed, "TILE_ROWS", tile)
    rows = cluster_rows(tile)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted([tuple(r) for r in ed.embedding_groups(df).collect()], key=str)
    assert got == brute_groups(rows)


def test_groups_edges(spark):
    schema = SCHEMA + ", node string, kept int"
    assert ed.embedding_groups(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, None, 1, "x", 1), (2, [1.0], 1, "y", 2)], schema)
    assert sorted(map(tuple, ed.embedding_groups(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 64))
    b = a + rng.normal(size=a.shape) * rng.choice([0.3, 0.39, 0.4, 0.41, 0.6], size=(300, 1))
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    full = ed.unit(a) @ ed.unit(b).T
    for t in (0.93, float(full[5, 5]), 0.2):
        for table in (axes, None):
            i, j = ed.close_pairs(a, b, table, t)
            want = set(zip(*np.nonzero(full >= t + 1e-9), strict=True))
            assert want <= set(zip(i, j, strict=True)) <= set(zip(*np.nonzero(full >= t - 1e-12), strict=True))


def brute_top(rows, asked, k):
    good = [(v, [math.floor(256 * x) for x in e]) for v, e in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    queries = {}
    for v, e in good:
        if v is not None and asked(v):
            queries[v] = min(queries.get(v, e), e)
    out = []
    for q, e in queries.items():
        ranked = sorted(((-sum(a * b for a, b in zip(e, x)), v is None, v or 0) for v, x in good if v != q))
        out += [(q, i + 1, None if none else v, -s) for i, (s, none, v) in enumerate(ranked[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [0.1, 3.0, 3e5])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SEED_ROWS", 7)
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "BROADCAST_BLOCKS", 2)
    rng = np.random.default_rng(int(scale))
    rows = [(i, [float(x) for x in rng.normal(size=9).round(1 if scale > 1 else 4) * scale])
            for i in range(220)]
    rows += [(400, None), (450, [None, 1.0]), (500, [float("nan")] * 9), (550, []), (600, rows[4][1][:4]),
             rows[7], rows[50], (None, rows[8][1]), (None, rows[8][1]), (700, [-0.001] * 9), (750, [0.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted([tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()], key=str)
    assert got == brute_top(rows, lambda v: v % 50 == 0, 5)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<double>, block string, rank int"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    df = spark.createDataFrame([(50, [1.0], "a", 1), (51, [-2.0], "b", 2)], schema)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert [tuple(r) for r in got.collect()] == [(50, 1, 51, -131072)]
