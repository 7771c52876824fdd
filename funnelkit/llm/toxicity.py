"""Toxicity scores from class-conditional Kneser-Ney models (operator 8).

Two unigram models, one per label, give each word a probability. A class's own
counts are discounted; the mass goes to a backoff that knows a word by its first
seven and first five bytes, counted in *types* (distinct words) as Kneser-Ney
asks, and at the bottom to counts that both classes share. So a rare or unseen
word is judged by the expressions it begins like, and a word that neither class
knows says nothing.

A document's score compares the length-normalised log-likelihoods: the mean of
its words' log-ratios, and the mean of what exceeds ``EXCESS`` (a few toxic
expressions in a long ordinary text stand out there). A logistic curve, fitted
to labelled documents that the models had not seen, turns both into 0 to 1.

All labelled rows outside the held-out fold are counted, every word and prefix
under its full 64-bit key. From the counts Spark computes one log-ratio per known
word, per known prefix (for words not seen) and one for words of unknown prefixes.
Up to ``MODEL_ROWS`` rows these tables are broadcast; larger ones are joined by
shuffle to the distinct words of each block of documents. Both give equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from funnelkit.llm import words as w
from funnelkit.llm.shared import sized, stage, with_row

Batches = Iterator[pa.RecordBatch]
FOLDS = 5
PREFIXES = (7, 5)
DISCOUNT, EXCESS = 0.75, 3.0
#: word and prefix ratios that may be broadcast (16 bytes each)
MODEL_ROWS = 1 << 22
#: a block of the shuffle join has at most ``2**BLOCK_BITS`` documents
BLOCK_BITS = 9
#: the logistic curve is fitted to at most about so many labelled rows
CALIBRATION_ROWS = 200_000
#: curve before any calibration row is seen: bias, mean ratio, mean excess
PRIOR = np.array([-4.0, 1.0, 80.0])
PRIOR_SCALE = np.array([3.0, 3.0, 60.0])

SEPARATORS = w.BLANKS.copy()
SEPARATORS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

COUNTS = ["f0", "f1", "c0", "c1"]  # tokens by class: fit folds, calibration fold


def word_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """([word, 7-byte prefix, 5-byte prefix] hashes, first word of each text)."""
    starts, ends, first = w.find_words(buf, offsets, SEPARATORS)
    keys = [w.hash_words(buf, starts, ends, w.BYTE_VALUES_LOWER)]
    for size in PREFIXES:
        keys.append(w.hash_words(buf, starts, np.minimum(ends, starts + size),
                                 w.BYTE_VALUES_LOWER))
    return keys, first


def _count(batches: Batches) -> Batches:
    """Rows (word, p7, p5, f0, f1, c0, c1) of distinct words; group 0-3 = fold part * 2 + label."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> pa.RecordBatch:
        word, p7, p5, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(word, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], word[order][1:] != word[order][:-1])))
        total = np.add.reduceat(counts[order], cut, axis=0)
        at = order[cut]
        return pa.RecordBatch.from_arrays(
            [pa.array(w.as_long(x[at])) for x in (word, p7, p5)]
            + [pa.array(np.ascontiguousarray(total[:, i])) for i in range(4)],
            names=["word", "p7", "p5", *COUNTS])

    size = 0
    for batch in batches:
        group = batch.column("grp").to_numpy()
        for lo, hi, buf, offsets in w.text_blocks(batch.column("text")):
            keys, first = word_keys(buf, offsets)
            if not len(keys[0]):
                continue
            code = np.repeat(group[lo:hi], np.diff(first))
            order = np.argsort(keys[0], kind="stable")
            word = keys[0][order]
            cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            counts = np.stack([np.add.reduceat((code[order] == g).astype(np.int64), cut)
                               for g in range(4)], axis=1)
            at = order[cut]
            held.append((keys[0][at], keys[1][at], keys[2][at], counts))
            size += len(at)
            if size > 1 << 20:
                yield merged()
                size = 0
    if held:
        yield merged()


@dataclass
class Model:
    """Log-ratios of known words, of words known by prefix only, and of all others."""

    keys: list[np.ndarray]    # word, 7-byte, 5-byte prefix: ascending hashes
    values: list[np.ndarray]  # their log P(word | toxic) - log P(word | ordinary)
    unknown: float

    def ratios(self, keys: list[np.ndarray]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        words, at, back = np.unique(keys[0], return_index=True, return_inverse=True)
        out = np.full(len(words), self.unknown)
        open_ = np.arange(len(words))
        for own, known, values in zip(keys, self.keys, self.values, strict=True):
            if not len(known) or not len(open_):
                continue
            want = own[at[open_]]
            place = np.minimum(np.searchsorted(known, want), len(known) - 1)
            hit = known[place] == want
            out[open_[hit]] = values[place[hit]]
            open_ = open_[~hit]
        return out[back]

    def features(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[texts, 2]: mean log-ratio and mean excess; zeros for texts without words."""
        keys, first = word_keys(buf, offsets)
        ratio = self.ratios(keys)
        counts = np.diff(first)
        some = np.flatnonzero(counts)
        out = np.zeros((len(counts), 2))
        if len(some):  # sums that depend on the text alone, not on its neighbours
            for i, x in enumerate((ratio, np.maximum(ratio - EXCESS, 0))):
                out[some, i] = np.add.reduceat(x, first[some]) / counts[some]
        return out


@dataclass
class Tables:
    """A model as stored tables (key, value); see ``Model``."""

    tables: list[DataFrame]
    unknown: float


def _sorted(table: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], table.column(value).to_numpy()[order]


def _log_ratio(kind: str, total: Row, own: bool, near: bool, far: bool) -> Column:
    """The ratio from a word's counts, its 7- and its 5-byte prefix's, where they are known."""
    def count(known: bool, prefix: str, c: int) -> Column:
        return F.col(f"{prefix}{kind}{c}").cast("double") if known else F.lit(0.0)

    def less(x: Column) -> Column:
        return F.greatest(x - DISCOUNT, F.lit(0.0))

    s7 = count(near, "p7_", 0) + count(near, "p7_", 1)
    s5 = count(far, "p5_", 0) + count(far, "p5_", 1)
    shared = (s5 + 0.5) / F.lit(float(total[f"n{kind}0"] + total[f"n{kind}1"]) + 5e3)
    out = []
    for c in (1, 0):
        n, v = float(total[f"{kind}{c}"]), float(total[f"n{kind}{c}"])
        n7, n5 = (float(total[f"{prefix}{kind}{c}"]) for prefix in ("p7_", "p5_"))
        p = less(count(far, "p5_", c)) / v + F.lit(DISCOUNT * n5 / v) * shared
        p = p * (s7 + 0.5) / (s5 + 1)
        p = less(count(near, "p7_", c)) / v + F.lit(DISCOUNT * n7 / v) * p
        out.append(less(count(own, "", c)) / n + F.lit(DISCOUNT * v / n) * p / (s7 + 1))
    return F.log(out[0] / out[1])


def fit_models(labelled: DataFrame, rows: int | None = None
               ) -> tuple[Model | Tables, Model | Tables]:
    """(without the calibration fold, of everything) from labelled(text, grp).

    Every word keeps its own counts, words seen once too. ``Tables`` if the model
    has more than ``rows`` (``MODEL_ROWS``) rows.
    """
    vocabulary = stage(labelled.mapInArrow(
        _count, "word long, p7 long, p5 long, f0 long, f1 long, c0 long, c1 long")
        .groupBy("word").agg(F.first("p7").alias("p7"), F.first("p5").alias("p5"),
                             *[F.sum(c).alias(c) for c in COUNTS])
        .select("word", "p7", "p5", "f0", "f1", (F.col("f0") + F.col("c0")).alias("a0"),
                (F.col("f1") + F.col("c1")).alias("a1")), "vocabulary")
    names = ["f0", "f1", "a0", "a1"]

    def types(prefix: str, *more: Column) -> DataFrame:
        return stage(vocabulary.groupBy(prefix).agg(*more, *[
            F.count_if(F.col(c) > 0).alias(f"{prefix}_{c}") for c in names]), "prefixes")
    near, far = types("p7", F.first("p5").alias("p5")), types("p5")
    total = vocabulary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names],
                           *[F.count_if(F.col(c) > 0).alias("n" + c) for c in names])
    for prefix, found in (("p7", near), ("p5", far)):
        total = total.crossJoin(found.agg(*[
            F.count_if(F.col(f"{prefix}_{c}") > 0).alias(f"{prefix}_{c}") for c in names]))
    total = total.first()
    kinds = [k for k in ("f", "a") if total[k + "0"] and total[k + "1"]]

    def ratios(table: DataFrame, key: str, *known: bool) -> DataFrame:
        return stage(table.select(F.col(key).alias("key"), *[
            _log_ratio(k, total, *known).alias(k) for k in kinds]), "ratios")
    tables = [ratios(vocabulary.join(near.drop("p5"), "p7").join(far, "p5"),
                     "word", True, True, True),
              ratios(near.join(far, "p5"), "p7", False, True, True),
              ratios(far, "p5", False, False, True)]
    spark = labelled.sparkSession
    unknown = spark.range(1).select(*[_log_ratio(k, total, False, False, False).alias(k)
                                      for k in kinds]).first()
    small = sum(t.count() for t in tables) <= (MODEL_ROWS if rows is None else rows)
    local = [t.toArrow() for t in tables] if small and kinds else []

    def model(kind: str) -> Model | Tables:
        if kind not in kinds:
            return Model([np.zeros(0, np.uint64)] * 3, [np.zeros(0)] * 3, 0.0)
        if not small:
            return Tables([t.select("key", F.col(kind).alias("value")) for t in tables],
                          unknown[kind])
        pairs = [_sorted(t, kind) for t in local]
        return Model([k for k, _ in pairs], [v for _, v in pairs], unknown[kind])
    return model("f"), model("a")


def fit_curve(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights (bias first) with a normal prior around ``PRIOR``, by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    weights, pull = PRIOR.copy(), 1 / PRIOR_SCALE**2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grad = x.T @ (p - labels) + pull * (weights - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, grad)
        step *= min(1.0, 20 / max(1e-9, float(np.abs(step / PRIOR_SCALE).max())))
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _batch(columns: list[str], batch: pa.RecordBatch, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in columns]
        + [pa.array(np.ascontiguousarray(values[:, i])) for i in range(2)],
        names=[*columns, "mean", "excess"])


def _measure(shared, columns: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        model = shared.value
        for batch in batches:
            for lo, hi, buf, offsets in w.text_blocks(w.texts_of(batch)):
                yield _batch(columns, batch.slice(lo, hi - lo), model.features(buf, offsets))
    return run


def _distinct(batches: Batches) -> Batches:
    """Rows (block, word, p7, p5): the distinct words of each part of a block."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for _, _, buf, offsets in w.text_blocks(batch.column("text").slice(a, b - a)):
                keys, _ = word_keys(buf, offsets)
                _, at = np.unique(keys[0], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), block[a]))]
                    + [pa.array(w.as_long(k[at])) for k in keys],
                    names=["block", "word", "p7", "p5"])


def _measure_block(columns: list[str], unknown: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        pair = _sorted(found, "value") if found.num_rows else (none, np.zeros(0))
        model = Model([pair[0], none, none], [pair[1], np.zeros(0), np.zeros(0)], unknown)
        parts = []
        for batch in docs.to_batches():
            for lo, hi, buf, offsets in w.text_blocks(w.texts_of(batch)):
                parts.append(_batch(columns, batch.slice(lo, hi - lo),
                                    model.features(buf, offsets)))
        return pa.Table.from_batches(parts)
    return run


def measure(docs: DataFrame, model: Model | Tables, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, mean and excess; the texts are in ``text``, else in ``row``."""
    kept = docs.select(*columns)
    schema = StructType(kept.schema.fields).add("mean", "double").add("excess", "double")
    if isinstance(model, Model):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        return docs.mapInArrow(_measure(shared, columns), schema)
    blocks = stage(docs.withColumn(
        "block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "blocks")
    text = F.col("text") if "text" in docs.columns else F.col("row.text").alias("text")
    found = blocks.select("block", text).mapInArrow(
        _distinct, "block long, word long, p7 long, p5 long")
    for key, table in zip(("word", "p7", "p5"), model.tables, strict=True):
        found = found.join(table.select(F.col("key").alias(key), F.col("value").alias("by_" + key)),
                           key, "left")
    found = found.select("block", F.col("word").alias("key"), F.coalesce(
        "by_word", "by_p7", "by_p5", F.lit(model.unknown)).alias("value"))
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _measure_block(columns, model.unknown), schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo ``FOLDS``; NULL ids have none."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(FOLDS))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (struct of all columns), held_out, score and predicted per row of ``docs``.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; other
    values and NULLs are no labels; of several rows for one id the larger
    counts). Fold 0 is held out and teaches nothing, fold 1 calibrates the
    curve, the others fit the models that it is calibrated on; the final model
    counts folds 1 to 4. Only the text is scored. NULL, empty and word-less texts
    get the score of no evidence. Without labels of both classes every text does.
    Rows without a doc_id are scored and teach nothing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    marks = stage(labels.select(F.col("doc_id").cast("long").alias("id"),
                                F.col("toxic").cast("int").alias("toxic"))
                  .where("id IS NOT NULL AND toxic IN (0, 1)").where(fold(F.col("id")) != 0)
                  .groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    own = F.col("doc_id").cast("long")
    part = F.when(fold(F.col("id")) == 1, F.lit(2)).otherwise(F.lit(0))
    labelled = docs.select(own.alias("own"), text).join(
        sized(marks), F.col("own") == F.col("id")).select(
        "text", "id", "toxic", (part + F.col("toxic")).cast("int").alias("grp"))
    trial, final = fit_models(labelled.select("text", "grp"))

    tests = marks.where(fold(F.col("id")) == 1)
    every = max(1, -(-tests.count() // CALIBRATION_ROWS))
    sample = sized(tests.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0))
    seen = docs.select(own.alias("own"), text).join(sample, F.col("own") == F.col("id"))
    seen = measure(seen.select("text", "toxic"), trial, ["toxic"]).toArrow()
    order = np.lexsort([seen.column(c).to_numpy() for c in ("toxic", "excess", "mean")])
    weights = fit_curve(
        np.column_stack([seen.column(c).to_numpy() for c in ("mean", "excess")])[order],
        seen.column("toxic").to_numpy()[order].astype(np.float64))

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    scored = measure(with_row(docs, held), final, ["row", "held_out"])
    x = F.lit(float(weights[0]))
    for value, name in zip(weights[1:].tolist(), ("mean", "excess"), strict=True):
        x = x + F.col(name) * F.lit(value)
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))
    return scored.select("row", "held_out", (1 / (1 + F.exp(-x))).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay."""
    kept = score_documents(docs, labels).where("predicted = 0")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_documents(docs, labels).select(
        F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")
