"""Vectorised word kernels over Arrow string columns.

A text column of an Arrow batch is one byte buffer plus offsets, so words of
thousands of documents are found and hashed with a few numpy passes. Texts are
cut into blocks of whole documents (``text_blocks``); a word never spans two
documents. NULL texts count as empty.

Hashes are 64-bit: a polynomial over random byte values modulo 2**64, then a
bijective mixer. Equal byte strings always collide; different ones do so with a
probability of about 2**-63 per pair.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: word separators of the contracts: blank and U+0009 to U+000D
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.default_rng(20260101)
BYTE_VALUES = _RNG.integers(1, 2**64 - 1, size=256, dtype=np.uint64)
#: the same, with A-Z read as a-z
BYTE_VALUES_LOWER = BYTE_VALUES.copy()
BYTE_VALUES_LOWER[65:91] = BYTE_VALUES[97:123]

_BASE = 0x9E3779B97F4A7C13  # odd and 3 modulo 8
_STEP = 0xD1342543DE82EF95
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _BLOCK + 1)
_INV = _powers(pow(_BASE, -1, 2**64), _BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64); returns a new array."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its column ``text``, else that field of ``row``."""
    if "text" in batch.schema.names:
        return batch.column("text")
    return batch.column("row").field("text")


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 21
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of documents of at most ``limit`` bytes (one at least).

    Yields ``(first row, row after the last, bytes, offsets from 0)``.
    """
    buf, off = string_buffer(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def find_words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word byte ranges, and per document the first word's index."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    begin[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    end[lasts] = inside[lasts]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of each word ``buf[start:end]`` (ranges ascending, disjoint)."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _BLOCK, side="right"))
        if j <= i:  # one word longer than a block: fold its blocks in sequence
            h, at = U(0), base
            while at < ends[i]:
                part = values[buf[at:min(at + _BLOCK, int(ends[i]))]]
                part = part * _POW[:len(part)]
                h = mix(np.array([h ^ np.add.reduce(part)], dtype=np.uint64))[0]
                at += _BLOCK
            out[i] = h
            i += 1
            continue
        stop = int(ends[j - 1])
        sums = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(values[buf[base:stop]] * _POW[:stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * _INV[s]
        i = j
    return mix(out)


def hash_grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (across documents too)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    step = _STEP
    power, size, done = words, 1, 0   # power: runs of `size` words
    out, mult = None, 1
    while True:
        if k & size:
            part = power[done:done + n]
            out = part * U(mult) if out is None else out + part * U(mult)
            mult = mult * pow(step, size, 2**64) % 2**64
            done += size
        if size * 2 > k:
            break
        power = power[:-size] + power[size:] * U(pow(step, size, 2**64))
        size *= 2
    return mix(out ^ U(k))


def gram_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, document) of the ``k``-word runs that stay inside one document."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    ahead = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(len(doc)) - np.repeat(ahead, counts) + np.repeat(first[:-1], counts), doc


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word ``k``-gram hashes of each document, A-Z read as a-z.

    A document of 1 to ``k - 1`` words has one element, its whole sequence.
    Returns ``(hashes, cuts)``: document ``i`` owns the ascending slice
    ``hashes[cuts[i]:cuts[i + 1]]``.
    """
    starts, ends, first = find_words(buf, offsets)
    words = hash_words(buf, starts, ends, BYTE_VALUES_LOWER)
    index, doc = gram_rows(first, k)
    grams = hash_grams(words, k)[index]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), dtype=np.uint64)
        for m in range(1, k):
            at = counts[short] == m
            if at.any():
                extra[at] = hash_grams(words, m)[first[short[at]]]
        doc = np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        grams, doc = np.concatenate((grams, extra))[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(len(counts) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        grams[a:b].sort()
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def release_memory() -> None:
    """Give back what Arrow and malloc hold for later use.

    Python workers are reused, so without it each carries the largest buffers of
    all its earlier tasks along.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def join_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
               keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): per document its kept words, joined by one blank each."""
    total = np.concatenate(([0], np.cumsum(keep)))
    counts = total[first[1:]] - total[first[:-1]]
    s, size = starts[keep], (ends - starts)[keep] + 1
    stops = np.cumsum(size)
    at = np.arange(int(stops[-1]) if len(stops) else 0)
    at += np.repeat(s - (stops - size), size)
    out = np.append(buf, np.uint8(0x20))[at]
    out[stops - 1] = 0x20
    # the blank after a document's last word goes
    last = np.cumsum(counts)[counts > 0] - 1
    whole = np.ones(len(out), dtype=bool)
    whole[stops[last] - 1] = False
    lengths = np.zeros(len(counts), dtype=np.int64)
    bounds = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(counts)))]
    lengths = np.diff(bounds) - (counts > 0)
    return out[whole], np.concatenate(([0], np.cumsum(lengths)))
