"""License scans by MinHash bands over overlapping text windows (operator 6).

Templates are grouped by length. For templates of up to ``L`` words a text is
read in windows of ``L + step`` words, one every ``step = max(1, L // 4)``, so
each place where a template can lie is inside one window. If a window contains
at least ``contain`` of a template's word 5-grams, their Jaccard similarity is
bounded below; the number of bands follows from that bound, so that such a
window and template agree on some band with a probability of at least
``certainty``. A window's MinHash is the minimum over its blocks of ``step``
shingles, so each shingle is hashed once however many windows overlap it.

Band hits retrieve templates; a hit counts only if the exact share of the
template's shingles found in the window reaches ``contain``.

Words are runs without blanks and ASCII punctuation, A-Z read as a-z.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm import words as w

Batches = Iterator[pa.RecordBatch]
#: shingle words, and MinHashes in a band: templates are short, and windows that share no shingle
#: with one agree on no MinHash, so bands of one row retrieve best
K, ROWS = 5, 1
#: windows of a text that are looked at together
PIECE = 1 << 14
#: template table rows that may be shared with the executors
MAX_TEMPLATES = 10_000

SEPARATORS = w.BLANKS.copy()
SEPARATORS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

# fixed values: wording of common license notices
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
                 "this software and associated documentation files (the \"Software\"), to deal in "
                 "the Software without restriction",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, "
                 "are permitted provided that the following conditions are met",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, "
                      "v. 2.0.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under "
                  "the terms of the GNU General Public License as published by the Free Software "
                  "Foundation",
}


def band_count(similarity: float, certainty: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` MinHashes that agree once with at least ``certainty``."""
    return max(1, math.ceil(math.log(1 - certainty) / math.log(1 - similarity**rows)))


class Templates:
    """Templates of one length class, their band table and the window plan."""

    def __init__(self, names: list[str], sets: list[np.ndarray], longest: int, contain: float,
                 certainty: float, seed: int = 11) -> None:
        self.names, self.sets, self.contain = names, sets, contain
        self.step = max(1, longest // 4)
        self.window = longest + self.step
        smallest = min(len(s) for s in sets)
        inside = max(1, math.ceil(contain * smallest))
        self.reach = max(1, -(-(self.window - K + 1) // self.step))   # blocks under one window
        wide = self.reach * self.step
        self.similarity = min(1.0, inside / (wide + smallest - inside))
        self.bands = band_count(self.similarity, certainty) if self.similarity < 1 else 1
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(1, 2**64 - 1, self.bands * ROWS, dtype=np.uint64)
        self.every = np.unique(np.concatenate(sets))
        self.table: dict[tuple[int, int], list[int]] = {}
        for t, s in enumerate(sets):
            for band, key in enumerate(self.keys(self.minima(s, np.array([0])))[:, 0].tolist()):
                self.table.setdefault((band, key), []).append(t)
        self.probe = [np.array(sorted(k for b, k in self.table if b == band), dtype=np.uint64)
                      for band in range(self.bands)]

    def minima(self, grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """[MinHash, block] minima of the blocks of ``grams`` that begin at ``cuts``."""
        twist = w.mix(grams ^ w.U(0x2545F4914F6CDD1D)) | w.U(1)
        return np.stack([np.minimum.reduceat((grams ^ salt) * twist, cuts) for salt in self.salt])

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """[band, window] band keys."""
        out = minima[0::ROWS].copy()
        for r in range(1, ROWS):
            out = w.mix(out) + minima[r::ROWS]
        return w.mix(out)

    @staticmethod
    def _hits(keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
        if len(probe) > 8:
            return np.isin(keys, probe)
        out = keys == probe[0]
        for key in probe[1:]:
            out |= keys == key
        return out

    def scan(self, grams: np.ndarray) -> dict[int, tuple[float, int]]:
        """{template: (share, window start)} of the best verified window of one text."""
        found: dict[int, tuple[float, int]] = {}
        blocks = -(-len(grams) // self.step)
        total = max(1, blocks - self.reach + 1) if blocks else 0
        for a in range(0, total, PIECE):   # so many windows at a time: memory is that of a piece
            b = min(a + PIECE, total)
            self._scan_piece(grams, a, b, found)
        return {t: (share, -at) for t, (share, at) in found.items()}

    def _scan_piece(self, grams: np.ndarray, a: int, b: int, found: dict[int, tuple[float, int]]
                    ) -> None:
        """Windows a to b - 1; window i is the blocks from i on."""
        step, reach = self.step, self.reach
        own = grams[a * step:(b + reach - 1) * step]
        low = self.minima(own, np.arange(0, len(own), step))
        wins = low[:, :b - a]
        for r in range(1, min(reach, low.shape[1])):
            wins = np.minimum(wins, low[:, r:r + b - a])
        keys = self.keys(wins)
        tried = set()
        for band in range(self.bands):
            for i in np.flatnonzero(self._hits(keys[band], self.probe[band])).tolist():
                for t in self.table[band, int(keys[band, i])]:
                    if (t, i) in tried:
                        continue
                    tried.add((t, i))
                    part = own[i * step:(i + reach) * step]
                    share = len(np.intersect1d(self.sets[t], part)) / len(self.sets[t])
                    if share >= self.contain:
                        best = found.get(t, (0.0, 0))
                        found[t] = max(best, (share, -(a + i) * step))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text)."""
    buf, offsets = w.string_buffer(texts)
    starts, ends, first = w.find_words(buf, offsets, SEPARATORS)
    return w.hash_words(buf, starts, ends, w.BYTE_VALUES_LOWER), first


def _grams(words: tuple[np.ndarray, np.ndarray], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hashes, cuts per text) in text order."""
    hashes, first = words
    index, doc = w.gram_rows(first, k)
    return w.hash_grams(hashes, k)[index], np.searchsorted(doc, np.arange(len(first)))


def short_templates(rows: list[tuple[str, str]]) -> dict[int, dict[int, list[str]]]:
    """Templates of 1 to ``K - 1`` words: {words: {hash of the whole: names}}."""
    out: dict[int, dict[int, list[str]]] = {}
    for name, text in rows:
        hashes, _ = _words(pa.array([text], pa.string()))
        if 0 < len(hashes) < K:
            key = int(w.hash_grams(hashes, len(hashes))[0])
            out.setdefault(len(hashes), {}).setdefault(key, []).append(name)
    return out


def length_classes(rows: list[tuple[str, str]], contain: float, certainty: float
                   ) -> list[Templates]:
    """Templates by length: within a class the longest is at most a quarter longer."""
    if not rows:
        return []
    grams, cuts = _grams(_words(pa.array([text for _, text in rows], pa.string())))
    sized = sorted((int(b - a) + K - 1, name, np.unique(grams[a:b]))
                   for (name, _), a, b in zip(rows, cuts[:-1], cuts[1:], strict=True) if b > a)
    out, group = [], []
    for item in [*sized, None]:
        if group and (item is None or item[0] > group[0][0] * 1.25):
            out.append(Templates([x[1] for x in group], [x[2] for x in group], group[-1][0],
                                 contain, certainty))
            group = []
        if item:
            group.append(item)
    return out


def _scan(shared) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        classes, short = shared.value
        for batch in batches:
            at, name, share, start, size = [], [], [], [], []
            for lo, hi, _, _ in w.text_blocks(batch.column("text")):
                words = _words(batch.column("text").slice(lo, hi - lo))
                grams, cuts = _grams(words)
                exact = [(m, keys, *_grams(words, m)) for m, keys in short.items()]
                bounds = cuts.tolist()
                for i in range(hi - lo):
                    for m, keys, whole, ends in exact:
                        part = whole[ends[i]:ends[i + 1]]
                        for key in set(part[np.isin(part, list(keys))].tolist()):
                            for label in keys[key]:
                                at.append(lo + i)
                                name.append(label)
                                share.append(1.0)
                                start.append(int(np.flatnonzero(part == w.U(key))[0]))
                                size.append(m)
                    own = grams[bounds[i]:bounds[i + 1]]
                    for group in classes:
                        for t, (part, begin) in group.scan(own).items():
                            at.append(lo + i)
                            name.append(group.names[t])
                            share.append(part)
                            start.append(begin)
                            size.append(min(group.window, len(own) + K - 1 - begin))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(at, pa.int64())), pa.array(name, pa.string()),
                 pa.array(share, pa.float64()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64())],
                names=["row", "license", "containment", "window_start", "window_words"])
    return run


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, contain: float = 0.8,
                  certainty: float = 0.999) -> DataFrame:
    """``row`` (struct of all columns), license, containment, window_start, window_words.

    One row per document and template found in its ``text``: the window with the
    highest containment (the first of several). ``templates(name, text)``
    defaults to ``TEMPLATES``; those of one to four words are found where they stand
    word for word, NULL texts and texts without words are ignored; equal names are templates of their own; at most
    ``MAX_TEMPLATES`` rows, as the band table is shared with every task. NULL,
    empty and shorter documents contain nothing. Repeated rows give repeated
    results, an empty table none.
    """
    spark = docs.sparkSession
    if templates is None:
        rows = list(TEMPLATES.items())
    else:
        rows = [tuple(r) for r in templates.where("text IS NOT NULL").select(
            F.coalesce(F.col("name").cast("string"), F.lit("")), F.col("text").cast("string"))
            .limit(MAX_TEMPLATES + 1).collect()]
        if len(rows) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
    shared = spark.sparkContext.broadcast(
        (length_classes(sorted(rows), contain, certainty), short_templates(sorted(rows))))
    source = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(_scan(shared), f"row {kind}, license string, containment double, "
                                            "window_start long, window_words long")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license notices in ``documents``, with the default templates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select(F.col("row.doc_id").alias("doc_id"), "license",
                                      "containment", "window_start", "window_words")
