"""Exact top-k search by inner product with MaxScore (operator 4).

Vectors become integers, ``floor(256 x)``. A *term* is a dimension with the sign
of the query's component; its postings are the candidates' components of that
dimension (a dense column per shard), and its bound is the largest product that
any candidate of the shard reaches. Components of the other sign only lower a
score, so a candidate's score is at most the sum of its terms' bounds.

Candidates are cut into shards, queries into blocks, and every shard meets every
block. In a shard a query's terms are ordered by bound. The last terms, whose
bounds together cannot lift a candidate above the threshold (the k-th best score
so far), are non-essential: candidates are scored on the essential postings, and
only those still competitive are probed for the others, one at a time, dropping
out as soon as the remaining bounds no longer suffice. Shards return their k
best, which one window merges. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.shared import sized, stage
from funnelkit.llm.vectors import matrix, usable

Batches = Iterator[pa.RecordBatch]
SHARD_ROWS, BLOCK_ROWS, CELLS = 4096, 128, 1 << 20
SCALE = 256.0
#: candidates scored in full to find the first threshold
SEED_ROWS = 256
#: query blocks that may be broadcast; more are shuffled to the shards
BROADCAST_BLOCKS = 512


def _pack(rows: int) -> Callable[[Batches], Batches]:
    """Blocks of rows: ids, which of them are present, and integer matrices as doubles."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            at = 0
            while at < len(batch):
                n = min(rows, len(batch) - at)
                while True:
                    part = batch.slice(at, n)
                    sizes = np.diff(np.asarray(part.column("vec").offsets))
                    if n == 1 or n * int(sizes.max(initial=0)) <= CELLS:
                        break
                    n = max(1, n // 2)
                x = matrix(part.column("vec"))
                with np.errstate(over="ignore"):
                    x = np.floor(x * SCALE) + 0.0
                if not np.isfinite(x).all():
                    raise ValueError("a component is too large to be scaled")
                ids = part.column("vec_id")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), pa.array([x.shape[1]], pa.int32()),
                     pa.array([ids.fill_null(0).to_numpy().tobytes()], pa.binary()),
                     pa.array([np.asarray(ids.is_valid()).tobytes()], pa.binary()),
                     pa.array([x.tobytes()], pa.binary())],
                    names=["n", "width", "ids", "known", "vecs"])
                at += n
    return run


def _products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return x @ q
    # beyond 2**53 doubles round: whole numbers of any size instead
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x],
                    dtype=object)


def max_score(x: np.ndarray, ids: np.ndarray, known: np.ndarray, query: np.ndarray,
              query_id: int, k: int) -> list[tuple[int, int]]:
    """(score, row) of the k best rows of ``x``; ties to the smaller id, unknown ids last."""
    rows = np.flatnonzero(~(known & (ids == query_id)))
    width = min(x.shape[1], len(query))
    x, query = x[:, :width], query[:width]
    if not len(rows):
        return []

    def best(at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if score.dtype == object:
            order = sorted(range(len(at)), key=lambda r: (-score[r], not known[at[r]], ids[at[r]]))
            order = np.array(order[:k], dtype=np.int64)
        else:
            order = np.lexsort((ids[at], ~known[at], -score))[:k]
        return at[order], score[order]

    top = np.abs(x).max(initial=0) * np.abs(query).max(initial=0) * max(1, width)
    if top >= 2.0**53:
        at, score = best(rows, _products(x[rows], query, False))
        return [(int(s), int(r)) for s, r in zip(score, at, strict=True)]
    bound = np.where(query > 0, query * np.maximum(x.max(axis=0), 0),
                     query * np.minimum(x.min(axis=0), 0)) if width else np.zeros(0)
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0.0]))  # bound of terms i and on
    seed, others = rows[:SEED_ROWS], rows[SEED_ROWS:]
    at, score = best(seed, _products(x[seed], query, True))
    if len(others):
        theta = score[-1] if len(score) == k else -np.inf
        # essential: the first terms; what follows them cannot reach theta alone
        essential = int(np.searchsorted(-rest, -theta, side="right")) if theta > 0 else width
        essential = max(1, min(width, essential)) if width else 0
        terms = order[:essential]
        partial = _products(x[np.ix_(others, terms)], query[terms], True)
        live = partial + rest[essential] >= theta
        others, partial = others[live], partial[live]
        for i in range(essential, width):
            if not len(others):
                break
            term = order[i]
            partial = partial + x[others, term] * query[term]
            live = partial + rest[i + 1] >= theta
            others, partial = others[live], partial[live]
        at, score = best(np.concatenate((at, others)), np.concatenate((score, partial)))
    return [(int(s), int(r)) for s, r in zip(score, at, strict=True)]


def _search(k: int) -> Callable[[Batches], Batches]:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def block(row: dict, letter: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (np.frombuffer(row[f"ids{letter}"], np.int64),
                np.frombuffer(row[f"known{letter}"], bool),
                np.frombuffer(row[f"vecs{letter}"]).reshape(row[f"n{letter}"], row[f"width{letter}"]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, x = block(row, "")
                names, _, queries = block(row, "_q")
                out: tuple[list, list, list] = ([], [], [])
                for name, query in zip(names.tolist(), queries, strict=True):
                    for score, r in max_score(x, ids, known, query, name, k):
                        out[0].append(name)
                        out[1].append(int(ids[r]) if known[r] else None)
                        out[2].append(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out], schema=schema)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each query.

    ``vectors`` has vec_id and embedding; ``is_query`` marks the queries. Vectors
    that are NULL or hold NULL or non-finite components take no part; in vectors
    of different length the missing components count nothing, an empty vector
    scores 0. Rows with the query's own vec_id are not its candidates; repeated
    rows are candidates of their own, but one query per vec_id is asked (its
    smallest vector). Rows without a vec_id are candidates that lose ties, never
    queries. A score beyond 64 bits fails the job. Other columns are ignored, an
    empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = stage(rows.where(usable(F.col("vec"))), "vectors")
    packed = "n int, width int, ids binary, known binary, vecs binary"
    shards = stage(rows.select("vec_id", "vec").mapInArrow(_pack(SHARD_ROWS), packed), "shards")
    asked = (rows.where("asked AND vec_id IS NOT NULL").groupBy("vec_id")
             .agg(F.min("vec").alias("vec")))
    blocks = stage(asked.mapInArrow(_pack(BLOCK_ROWS), packed), "queries")
    count = blocks.count()
    if not count:
        return spark_empty(vectors.sparkSession)
    # number the blocks through their first query, over one row per block
    heads = blocks.select("ids").withColumn(
        "block", F.row_number().over(Window.orderBy("ids")) - 1)
    numbered = stage(blocks.join(heads, "ids").select(
        "block", *[F.col(c).alias(f"{c}_q") for c in ("n", "width", "ids", "known", "vecs")]), "blocks")
    work = (shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
            .join(sized(numbered, BROADCAST_BLOCKS), "block"))
    found = work.drop("block").repartition(max(1, min(
        count * shards.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def spark_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op4_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 4: every 50th of the ``embeddings`` against all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(256 * e)) AS x
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
