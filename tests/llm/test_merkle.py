"""The Merkle manifest against a plain tree, ranks against sorted positions."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from funnelkit.llm import merkle
from funnelkit.llm.merkle import fold, group_key, leaf_hash, leaf_slots, manifest, proof_digest
from funnelkit.llm.shared import stage

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """(root, path of each node): the siblings and the place in each run."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            lo = i // fanout * fanout
            run = nodes[lo:lo + fanout]
            p.append((i - lo, "".join(run[:i - lo] + run[i - lo + 1:])))
        at = [i // fanout for i in at]
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made, subs = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = tree([leaf(r) for r in own], fanout)
        subs.append(sub)
        made.append((own, sub, paths))
    root, crown = tree(subs, fanout)
    out = []
    for (own, sub, paths), top in zip(made, crown, strict=True):
        for r, p in zip(own, paths, strict=True):
            n = r[3]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and n is not None:
                n += 1
            node = leaf((*r[:3], n, r[4]))
            for pos, others in p + top:
                node = h(others[:64 * pos], node, others[64 * pos:])
            out.append((r[0], leaf(r), sub, root, h(*[o for _, o in p + top]), node))
    return sorted(out, key=repr)


def run(spark, rows, fanout=2):
    docs = spark.createDataFrame(rows, SCHEMA)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    forged = F.when(hit, leaf_hash(*fields[:3], F.col("n_chars") + 1, fields[4])).otherwise(leaf_hash(*fields))
    made = manifest(docs, leaf_hash(*fields), F.coalesce(forged, leaf_hash(*fields)), fanout=fanout)
    return sorted((tuple(r) for r in made.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")),
        fold(F.col("forged"), F.col("path"))).collect()), key=repr)


def documents(n, seed=1):
    rng = random.Random(seed)
    langs = ["en", "en", "en", "de", None, "é", "", "zz"]
    wide = [0, 1, -1, 63, 64, -64, 2**63 - 1, -2**63, 2**40, 1 << 16, (1 << 32) + 5]
    rows = [(wide[i] if i < len(wide) else rng.randrange(-3 * n, 10 * n), rng.choice(["a", None]),
             rng.choice(langs), rng.choice([None, 5, 7]), rng.choice(["", "x", None, "long " * 500]))
            for i in range(n)]
    return rows + rows[5:9] * 3 + [(None, "s", "en", 3, "t"), (None, "s", "en", 4, "u")] * 2 + \
        [(7, "a", "en", 1, str(i)) for i in range(30)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_equals_plain_tree(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "ARRAY", 8)   # several rounds of arrays, lone last nodes
    monkeypatch.setattr(merkle, "SPAN", 4)
    rows = documents(150)
    assert run(spark, rows, fanout) == brute(rows, fanout)


def test_large_arrays(spark):
    rows = [(i * 3, "s", "en", 1, str(i)) for i in range(1100)]
    assert run(spark, rows) == brute(rows, 2)


def test_slots_are_ranks(spark):
    rows = documents(200, seed=5)
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = stage(docs.select(group_key(F.col("lang")).alias("grp"), "doc_id", F.lit("f").alias("forged"),
                               F.sha2(F.col("doc_id").cast("string"), 256).alias("leaf")), "test-leaves")
    got = {}
    for r in leaf_slots(leaves).collect():
        got.setdefault(r["grp"], []).append((r["slot"], r["doc_id"], r["n"]))
    for slots in got.values():
        slots.sort()
        assert [s for s, _, _ in slots] == list(range(len(slots)))
        ids = [d for _, d, _ in slots]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
        assert {n for _, _, n in slots} == {len(slots)}


def test_single_row_and_empty_table(spark):
    rows = [(3, None, None, None, None)]
    assert run(spark, rows) == brute(rows, 2)
    assert run(spark, rows)[0][1] == run(spark, rows)[0][3]   # a lone leaf is the root
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest(empty, leaf_hash(F.col("doc_id"))).collect() == []


def test_clashing_columns_are_ignored(spark):
    docs = spark.createDataFrame([(1, "en", 9, "x"), (2, "en", 9, "y")],
                                 "doc_id long, lang string, slot long, node string")
    made = manifest(docs, leaf_hash(F.col("doc_id")))
    assert sorted(r["slot"] for r in made.collect()) == [0, 1]
