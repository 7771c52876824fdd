"""Phrase collocation mining by top-order marginalisation (operator 11).

Only the longest windows are counted. Each word leads a window of ``width``
columns: itself and the words after it, NULL beyond the end of its piece. A
phrase of k words occurs exactly as often as windows begin with it, so the
counts of all shorter phrases are marginals of the longest: Spark's ROLLUP over
(lang, w1, ..., w_width) sums them, prefix by prefix, and its level of the bare
language is the number of words. No n-gram is exploded.

Texts become pieces at ``[.,;:!?]`` and line breaks (U+000A to U+000D), pieces
words at blanks and tabs, A-Z is read as a-z. Tasks find and hash the words of a
few MB of texts at once (see ``words``), and equal windows of such a block leave it
as one row with their number. A phrase that occurs ``least`` times has parts that
do, so what stays behind the ROLLUP holds every part that a score needs, and is at
most a ``least``-th of the words per order.

Most long phrases are rare and would fill the shuffle. So occurrences are first
counted by hash bucket, and a window ends before its k-th word if the bucket of its
first k words holds fewer than ``least``. A bucket counts at least what each of its
phrases does, so no phrase that reaches ``least`` loses a window: the filter
never changes a result, and words are compared as text. For the count the buckets
form blocks; a task sends two bytes per occurrence to the block's row, and no more
than ``least`` of one bucket at a time. The filter is one bit a bucket,
2**FILTER_BITS of them, broadcast (16 MB at 27); where far more phrases than buckets
exist it cuts little, and the shuffle of the windows grows towards one row per
distinct window.

Every shuffle is pre-aggregated: a word that is a third of the corpus arrives
as one row per task. Ranks are taken per (lang, salt) first, so a language that
holds all rows sends ``top`` rows per salt to its last step. Joins carry no
hints; Spark broadcasts by measured size and splits skewed keys.

Defined results: NULL and empty texts have no words; a NULL lang is ``und`` and
merges with that name; repeated rows count each time; ties rank by phrase in
UTF-8 byte order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm import words as w
from funnelkit.llm.shared import stage

Batches = Iterator[pa.RecordBatch]
#: bytes that end a piece: .,;:!? and U+000A to U+000D
PIECE_ENDS = np.zeros(256, dtype=bool)
PIECE_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
#: bytes that end a word: those, blank and tab
WORD_ENDS = PIECE_ENDS.copy()
WORD_ENDS[list(b" \t")] = True
#: A-Z as a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of texts that are cut at once
TEXT_BYTES = 1 << 22
#: the filter of rare phrases has 2**FILTER_BITS buckets
FILTER_BITS = 27
#: a block holds 2**BLOCK_BITS buckets (places of two bytes)
BLOCK_BITS = 15
#: occurrences a task gathers before it sends them to their blocks
HELD = 1 << 22
#: groups that a language's ranking is split into before its last step
SALTS = 32


def _cut(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """Blocks of texts as ``(words, langs, of, buckets)``.

    Lower-cased words, the distinct langs and each word's index there; per order from 2
    the bucket of the words that start at each word, -1 where the piece has fewer.
    """
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy()
    names, edges = w.string_buffer(langs.dictionary)
    salt = w.hash_words(names, edges[:-1], edges[1:])
    for lo, hi, buf, offsets in w.text_blocks(batch.column("text"), TEXT_BYTES):
        starts, ends, first = w.find_words(buf, offsets, WORD_ENDS)
        n = len(starts)
        if not n:
            continue
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        piece = np.searchsorted(np.flatnonzero(PIECE_ENDS[buf]), starts) + doc
        hashes = w.hash_words(buf, starts, ends, w.BYTE_VALUES_LOWER)
        of = codes[lo:hi][doc]
        buckets = []
        for k in range(2, width + 1):
            bucket = np.full(n, -1, dtype=np.int64)
            if n >= k:
                places = (w.hash_grams(hashes, k) ^ salt[of[:n - k + 1]]) >> w.U(64 - FILTER_BITS)
                bucket[:n - k + 1] = np.where(piece[k - 1:] == piece[:n - k + 1], places.view(np.int64), -1)
            buckets.append(bucket)
        edges = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), n, [
            None, pa.py_buffer(edges), pa.py_buffer(LOWER[buf[~WORD_ENDS[buf]]])])
        yield words, langs.dictionary, of, buckets


def _packed(held: list[np.ndarray], least: int) -> pa.RecordBatch:
    """A row per block: the places of its buckets, each up to ``least`` times."""
    found = np.sort(np.concatenate(held))
    enough = np.ones(len(found), dtype=bool)
    enough[least:] = found[least:] != found[:-least]
    found = found[enough]
    block = found >> BLOCK_BITS
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    places = (found & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
    edges = (np.append(cuts, len(found)) * places.itemsize).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(block[cuts].astype(np.int32)), pa.Array.from_buffers(
            pa.binary(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(places)])],
        names=["block", "places"])


def _occurrences(width: int, least: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in batches:
            for _, _, _, buckets in _cut(batch, width):
                held += [b[b >= 0].astype(np.uint32) for b in buckets]
                size += sum(map(len, held[-len(buckets):]))
                if size >= HELD:
                    yield _packed(held, least)
                    held, size = [], 0
        if size:
            yield _packed(held, least)
        w.release_memory()
    return run


def _frequent(least: int) -> Callable[[Batches], Batches]:
    """Bits of each block: whether a bucket holds ``least`` occurrences."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            bits = []
            for places in batch.column("places"):
                found = np.frombuffer(b"".join(p.as_py() for p in places), dtype=np.uint16)
                bits.append(np.packbits(np.bincount(found, minlength=1 << BLOCK_BITS) >= least,
                                        bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bits, pa.binary())],
                                             names=["block", "bits"])
    return run


def _lead(width: int, often: Broadcast | None) -> Callable[[Batches], Batches]:
    """Distinct windows of each block of texts with their number ``f``."""
    names = [f"w{k + 1}" for k in range(width)]

    def run(batches: Batches) -> Batches:
        bits = often.value if often else None
        for batch in batches:
            for words, langs, of, buckets in _cut(batch, width):
                words = words.dictionary_encode()
                code = words.indices.to_numpy()
                columns, alive = [code], np.ones(len(code), dtype=bool)
                for k, bucket in enumerate(buckets, 1):
                    alive &= bucket >= 0
                    if bits is not None:
                        at = bucket[alive]
                        alive[alive] = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                    here = np.flatnonzero(alive)
                    column = np.full(len(code), -1, dtype=np.int32)
                    column[here] = code[here + k]
                    columns.append(column)
                counted = pa.table([of, *columns], names=["lang", *names]).group_by(
                    ["lang", *names], use_threads=False).aggregate([([], "count_all")])
                out = [langs.take(counted["lang"].combine_chunks())]
                for name in names:
                    column = counted[name].to_numpy()
                    out.append(words.dictionary.take(pa.array(column, mask=column < 0)))
                yield pa.RecordBatch.from_arrays([*out, counted["count_all"].combine_chunks()],
                                                 names=["lang", *names, "f"])
        w.release_memory()
    return run


def _windows(docs: DataFrame, width: int, often: Broadcast | None = None) -> DataFrame:
    """``lang, w1 .. w_width, f``: windows, NULL beyond their piece, and their number in a block."""
    names = ", ".join(f"w{k + 1} string" for k in range(width))
    return _texts(docs).mapInArrow(_lead(width, often), f"lang string, {names}, f long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def lead_windows(docs: DataFrame, width: int) -> DataFrame:
    """``lang, w1 .. w_width``: one row per word, NULL columns beyond its piece."""
    return _windows(docs, width).withColumn("f", F.explode(F.sequence(F.lit(1).cast("long"), "f"))).drop("f")


def _without_rare(docs: DataFrame, width: int, least: int) -> DataFrame:
    """The windows, each ended before the first prefix that is surely rare."""
    blocks = (_texts(docs).mapInArrow(_occurrences(width, least), "block int, places binary")
              .groupBy("block").agg(F.collect_list("places").alias("places"))
              .mapInArrow(_frequent(least), "block int, bits binary"))
    often = np.zeros((1 << FILTER_BITS - BLOCK_BITS, (1 << BLOCK_BITS) // 8), dtype=np.uint8)
    for block, bits in blocks.collect():   # 16 MB at 27 bits, whatever the corpus
        often[block] = np.frombuffer(bits, dtype=np.uint8)
    return _windows(docs, width, docs.sparkSession.sparkContext.broadcast(often.reshape(-1)))


def phrase_counts(docs: DataFrame, width: int = 3, least: int = 10) -> DataFrame:
    """``lang, words, size, f``: phrases of 1 to ``width`` words that occur ``least`` times.

    The row of size 0 holds the number of all words of its language.
    """
    names = [f"w{k + 1}" for k in range(width)]
    longest = _without_rare(docs, width, least).groupBy("lang", *names).agg(F.sum("f").alias("f"))
    rolled = longest.rollup("lang", *names).agg(F.sum("f").alias("f"),
                                                F.grouping_id().alias("level"))
    # grouping_id has a bit for each column that was summed away
    size = F.when(F.col("level") == 2**width - 1, 0)
    whole = F.col("level") == 2**width - 1
    for k in range(1, width + 1):
        at = F.col("level") == 2**(width - k) - 1
        size = size.when(at, k)
        whole |= at & F.col(names[k - 1]).isNotNull() & (F.col("f") >= least)
    return rolled.where(whole).select(
        "lang", F.array_compact(F.array(*names)).alias("words"), size.alias("size"), "f")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts up to 10**15."""
    whole = "decimal(20,0)"
    top = F.lit(1_000_000).cast("decimal(7,0)") * a.cast(whole) * a.cast(whole)
    return F.call_function("div", top, left.cast(whole) * right.cast(whole))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, width: int = 3, least: int = 10, top: int | None = 2000,
                 cover: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the collocations of each language.

    ``docs`` has ``lang`` and ``text``. A phrase of 2 to ``width`` words is scored
    at its worst cut (ties: the first). It goes if some longer candidate holds its
    words contiguously in at least ``cover`` per cent of its occurrences.
    ``top=None`` ranks all.
    """
    if width < 2 or least < 1:
        raise ValueError("width must be 2 or more, least positive")
    counts = stage(phrase_counts(docs, width, least), "phrases")
    found = counts.where("size >= 2")
    part = counts.where("size BETWEEN 1 AND {:d}".format(width - 1)).select(
        "lang", _joined(F.col("words")).alias("part"), "f")

    cuts = found.select("lang", "words", F.col("f").alias("a"),
                        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "a", "k", _joined(F.col("words")).alias("phrase"),
                       _joined(F.slice("words", F.lit(1), F.col("k"))).alias("first"),
                       _joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"))
    sides = (cuts.join(part.toDF("lang", "first", "l"), ["lang", "first"])
             .join(part.toDF("lang", "rest", "r"), ["lang", "rest"]))
    worst = sides.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
        .alias("cut"))

    inner = [F.struct(F.lit(i + 1).alias("at"), F.lit(m).alias("size"))
             for m in range(2, width) for i in range(width - m + 1)]
    if inner:
        longer = (found.where("size > 2").withColumn("in", F.explode(F.array(*inner)))
                  .where("in.size < size AND in.at + in.size - 1 <= size")
                  .groupBy("lang", _joined(F.slice("words", F.col("in.at"), F.col("in.size")))
                           .alias("phrase")).agg(F.max("f").alias("most")))
        worst = worst.join(longer, ["lang", "phrase"], "left").where(
            F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover))
    flat = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        near = Window.partitionBy("lang", "salt").orderBy(*order)
        flat = (flat.withColumn("salt", salt).withColumn("near", F.row_number().over(near))
                .where(F.col("near") <= top).drop("salt", "near"))
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 11 over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return collocations(docs)


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
      FROM pieces),
grams AS (  -- every contiguous phrase of one to three words, exploded
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (VALUES (1), (2), (3)) AS s(k)
  WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
halves AS (
  SELECT lang, phrase, k, a, i, array_to_string(w[1:i], ' ') AS one, array_to_string(w[i + 1:], ' ') AS two
  FROM cand, (VALUES (1), (2)) AS s(i) WHERE i < k),
cuts AS (
  SELECT h.lang, h.phrase, h.k, h.a, h.i, x.f AS l, y.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * h.a * h.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM halves h JOIN f x ON (x.lang, x.phrase) = (h.lang, h.one)
                JOIN f y ON (y.lang || chr(10) || y.phrase) = (h.lang || chr(10) || h.two)),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a
    FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN inside USING (lang, phrase)
         WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""
