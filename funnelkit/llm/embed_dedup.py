"""Embedding near-dedup by PCA-ordered tiled comparison (operator 9).

Vectors are compared inside one label. Equal vectors are one node with a
multiplicity. The principal axes of all vectors (second moments of the unit
vectors, summed where the data lie) give a rotation that puts the most telling
dimensions first and leaves every cosine as it is. Nodes are range-partitioned
by label and first coordinate and cut into tiles. Unit vectors with cosine
``t`` are at most ``sqrt(2 - 2 t)`` apart in each coordinate, so only pairs of
tiles whose ranges of first coordinates come that close are compared.

A pair of tiles accumulates products of the leading dimensions first. What the
rest can add is at most the product of the suffix norms; pairs that cannot reach
the threshold any more are dropped before the next dimensions. Cosines at the
threshold itself are decided on the vectors as given, in double precision.

A tile pair reports, per node, how many vectors it links to, and a spanning
forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.components import components
from funnelkit.llm.shared import shuffle_width, stage
from funnelkit.llm.vectors import matrix, usable

Batches = Iterator[pa.RecordBatch]
TILE_ROWS, TILE_BYTES = 1024, 4 << 20
#: wider vectors are compared without rotation
PCA_WIDTH = 1024
#: cosines this close to the threshold are recomputed from the given vectors
CLOSE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (largest component first, so nothing overflows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(width: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                u = unit(matrix(batch.column("vec"), width))
                total += (u * batch.column("copies").to_numpy()[:, None]).T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])
    return run


def _sum_moments(batches: Batches) -> Batches:
    total = None
    for batch in batches:
        for blob in batch.column("m").to_pylist():
            part = np.frombuffer(blob)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])


def principal_axes(nodes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal [width, width]; column i is the i-th principal axis."""
    parts = nodes.where(F.size("vec") == width).select("vec", "copies").mapInArrow(
        _moments(width), "m binary")
    found = parts.repartition(8).mapInArrow(_sum_moments, "m binary").collect()  # 8 small matrices
    total = np.zeros((width, width))
    for row in found:
        total += np.frombuffer(row.m).reshape(width, width)
    _, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, ::-1])


def _lead(axes) -> Callable[[Batches], Batches]:
    """Add the first coordinate."""
    def run(batches: Batches) -> Batches:
        table = axes.value
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("vec").offsets))
            lead = np.zeros(len(batch))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                u = unit(matrix(batch.column("vec").take(pa.array(at)), int(size)))
                lead[at] = u @ table[:, 0] if table is not None and len(table) == size else u[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)],
                                             names=[*batch.schema.names, "lead"])
    return run


def _tile(batches: Batches) -> Batches:
    """Tiles of rows with one label and width; input sorted by label, width, lead."""
    name, held, size = None, [], 0

    def tile() -> pa.RecordBatch:
        vec = np.array([h[3] for h in held])
        lead = [h[4] for h in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0][1]], pa.int64()), pa.array([name[0]], pa.int64()),
             pa.array([name[1]], pa.int32()), pa.array([lead[0]]), pa.array([lead[-1]]),
             pa.array([np.array([h[1] for h in held]).tobytes()], pa.binary()),
             pa.array([np.array([h[2] for h in held]).tobytes()], pa.binary()),
             pa.array([vec.tobytes()], pa.binary())],
            names=["tile", "label", "width", "lo", "hi", "nodes", "copies", "vecs"])

    for batch in batches:
        for label, width, node, copies, vec, lead in zip(*(batch.column(c).to_pylist() for c in (
                "label", "width", "node", "copies", "vec", "lead")), strict=True):
            full = len(held) >= TILE_ROWS or size + 8 * width > TILE_BYTES
            if held and ((label, width) != name or full):
                yield tile()
                held, size = [], 0
            name = (label, width)
            held.append((label, node, copies, vec, lead))
            size += 8 * width
    if held:
        yield tile()


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float
                ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine(a[i], b[j]) >= threshold."""
    ua, ub = unit(a), unit(b)
    if axes is not None and len(axes) == a.shape[1]:
        ya, yb = ua @ axes, ub @ axes
    else:
        ya, yb = ua, ub

    def suffix(y: np.ndarray) -> np.ndarray:
        tail = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate((tail, np.zeros((len(y), 1))), axis=1))

    sa, sb, d = suffix(ya), suffix(yb), a.shape[1]
    floor = threshold - CLOSE
    at = min(d, 16)
    part = ya[:, :at] @ yb[:, :at].T
    i, j = np.nonzero(part + np.outer(sa[:, at], sb[:, at]) >= floor)
    dot = part[i, j]
    while at < d:
        to = min(d, at * 2)
        out = np.empty(len(i))
        for lo in range(0, len(i), 1 << 16):   # bounded memory for many survivors
            s = slice(lo, lo + (1 << 16))
            out[s] = np.einsum("ij,ij->i", ya[i[s], at:to], yb[j[s], at:to])
        dot = dot + out
        at = to
        keep = dot + sa[i, at] * sb[j, at] >= floor
        i, j, dot = i[keep], j[keep], dot[keep]
    sure = dot >= threshold + CLOSE
    for k in np.flatnonzero(~sure):
        x, y = a[i[k]], b[j[k]]
        sure[k] = float(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold
    return i[sure], j[sure]


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links (x, y): each node and its smallest."""
    nodes, flat = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = flat[:len(x)], flat[len(x):]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[at], nodes[low[at]]


def _compare(axes, threshold: float) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        table = axes.value
        for batch in batches:
            for row in batch.to_pylist():
                node = [np.frombuffer(row[c], np.int64) for c in ("nodes_a", "nodes_b")]
                copies = [np.frombuffer(row[c], np.int64) for c in ("copies_a", "copies_b")]
                vec = [np.frombuffer(row[c]).reshape(-1, row["width"]) for c in ("vecs_a", "vecs_b")]
                i, j = close_pairs(vec[0], vec[1], table, threshold)
                if row["a"] == row["b"]:
                    other = i != j
                    i, j = i[other], j[other]
                if not len(i):
                    continue
                # within one tile each link is found from both sides
                degree = np.bincount(i, copies[1][j], len(node[0])).astype(np.int64)
                ends, sums = [node[0]], [degree]
                if row["a"] != row["b"]:
                    ends.append(node[1])
                    sums.append(np.bincount(j, copies[0][i], len(node[1])).astype(np.int64))
                ends, sums = np.concatenate(ends), np.concatenate(sums)
                at = np.flatnonzero(sums)
                p, q = _forest(node[0][i], node[1][j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((ends[at], p))),
                     pa.array(np.concatenate((ends[at], q))),
                     pa.array(np.concatenate((sums[at], np.zeros(len(p), np.int64))))],
                    names=["a", "b", "links"])
    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept per row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and not NULL and the cosine of their
    embeddings is at least ``threshold`` (above 0). Vectors that are NULL, empty
    or zero or hold a NULL or non-finite component, or differ in length, do not
    link. Repeated rows are vectors of their own and link with each other. A NULL
    vec_id counts as larger than all others. Other columns are ignored; an empty
    table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = vectors.sparkSession
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"),
                          F.col("label").cast("long").alias("label"))
    good = usable(F.col("vec")) & F.col("label").isNotNull() & F.exists(
        F.coalesce("vec", F.array()), lambda x: x != 0)
    # -0.0 and 0.0 are one value
    plain = F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn(
        "vec", F.when(F.col("good"), plain))
    rows = stage(rows.withColumn("node", F.when(F.col("good"), F.xxhash64("label", "vec"))),
                 "vectors")
    nodes = stage(rows.where("good").groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("vec").alias("vec"),
        F.count("*").alias("copies")), "nodes").withColumn("width", F.size("vec"))
    usual = nodes.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).first()
    width = usual[0] if usual else 0
    axes = spark.sparkContext.broadcast(
        principal_axes(nodes, width) if 0 < width <= PCA_WIDTH else None)

    led = nodes.select("label", "width", "node", "copies", "vec").mapInArrow(
        _lead(axes), "label long, width int, node long, copies long, vec array<double>, lead double")
    kind = ("tile long, label long, width int, lo double, hi double, nodes binary, "
            "copies binary, vecs binary")
    ranges = max(1, min(shuffle_width(spark), -(-nodes.count() // TILE_ROWS)))
    tiles = stage(led.repartitionByRange(ranges, "label", "width", "lead")
                  .sortWithinPartitions("label", "width", "lead").mapInArrow(_tile, kind), "tiles")

    reach = (2 - 2 * threshold) ** 0.5 + 1e-9
    left = tiles.select("label", "width", F.col("tile").alias("a"), F.col("lo").alias("lo_a"),
                        F.col("hi").alias("hi_a"))
    right = tiles.select("label", "width", F.col("tile").alias("b"), F.col("lo").alias("lo_b"),
                         F.col("hi").alias("hi_b"))
    first = (F.col("lo_a") < F.col("lo_b")) | ((F.col("lo_a") == F.col("lo_b"))
                                               & (F.col("a") <= F.col("b")))
    pairs = (left.join(right, ["label", "width"])
             .where(first & (F.col("lo_b") - F.col("hi_a") <= reach)).select("width", "a", "b"))

    def side(letter: str) -> DataFrame:
        return tiles.select(F.col("tile").alias(letter), *[
            F.col(c).alias(f"{c}_{letter}") for c in ("nodes", "copies", "vecs")])

    work = (pairs.join(side("a"), "a").join(side("b"), "b")
            .repartition(shuffle_width(spark), "a", "b"))
    found = stage(work.mapInArrow(_compare(axes, threshold), "a long, b long, links long"), "links")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b").select("a", "b"))

    named = stage(nodes.select("node", "copies").join(links, "node", "left")
                  .join(roots, "node", "left")
                  .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
                          .alias("n_links"), F.coalesce("root", "node").alias("root")), "groups")
    tagged = stage(rows.where("good").select("vec_id", "node").join(named, "node"), "tagged")
    lowest = tagged.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = tagged.join(lowest, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_pca_tiled_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9 over all ``embeddings``."""
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
   AND list_cosine_similarity(a.x, b.x) >= 0.93
), reach(node, low) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT links.a, reach.low FROM reach JOIN links ON links.b = reach.node
), low AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links,
       coalesce(low.low, e.vec_id) AS component_id,
       coalesce(low.low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN low ON low.node = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id
"""
