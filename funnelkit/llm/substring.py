"""Substring dedup by relative Lempel-Ziv parsing (operator 5).

Every document is parsed against all that starts earlier in the corpus (a
smaller doc_id, or the same document further left). The reference is indexed by
its windows of ``window`` words, cut into blocks by hash, one block per shuffle
partition. A document's window starts are looked up in each block that can hold
them; a factor is a greedily extended run of starts whose earliest occurrences
advance together in one reference document, so it is a copied passage of at
least ``window`` words. At a factor's end the parse goes on with the very next
start, so windows across two factors are checked too. The words under the
factors are the duplicate spans.

Only windows that can repeat are indexed. The *anchor* of a window is its
smallest word ``gram`` hash; equal windows have equal anchors at equal offsets.
A first pass finds the anchors that occur twice in the corpus (about one word in
seven is an anchor); only windows with such an anchor enter the index. Repeats
inside one block of texts are settled there, so of a passage that a third of
all documents share only one row per block travels.

Positions are judged on the input. Rows of one doc_id are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm import words as w
from funnelkit.llm.shared import shuffle_width, stage, with_row

Batches = Iterator[pa.RecordBatch]
#: a doc_id that is NULL comes after all others
NO_ID = 2**63 - 1
#: bytes of anchor positions or factors that may be broadcast; beyond: shuffled join
BROADCAST_BYTES = 64 << 20
LOW = np.int64(0xFFFFFFFF)


def anchors(words: np.ndarray, first: np.ndarray, window: int, gram: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, their documents, anchor positions, gram hashes) of a block."""
    index, doc = w.gram_rows(first, window)
    grams = w.hash_grams(words, gram)
    if not len(index):
        return index, doc, index, grams
    bits = max(24, int(len(grams)).bit_length())  # one tie rule for all usual blocks
    low = w.U((1 << bits) - 1)
    lead = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, size = window - gram + 1, 1
    while size * 2 <= span:
        lead = np.minimum(lead[:-size], lead[size:])
        size *= 2
    if size < span:
        lead = np.minimum(lead[:len(lead) - (span - size)], lead[span - size:])
    return index, doc, (lead[index] & low).astype(np.int64), grams


def _positions(ids: np.ndarray, tags: np.ndarray, first: np.ndarray, doc: np.ndarray,
               at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document id, position << 32 | text tag) of word indexes ``at``."""
    return ids[doc], ((at - first[doc]) << 32) | tags[doc]


def _find_anchors(window: int, gram: int) -> Callable[[Batches], Batches]:
    """Rows (key, doc, at, known): known 0 asks for its key, 1 also answers, 2 only answers."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, tags = batch.column("did").to_numpy(), batch.column("tag").to_numpy()
            for lo, hi, buf, offsets in w.text_blocks(batch.column("text")):
                starts, ends, first = w.find_words(buf, offsets)
                hashes = w.hash_words(buf, starts, ends)
                _, doc, spot, grams = anchors(hashes, first, window, gram)
                if not len(spot):
                    continue
                fresh = np.ones(len(spot), dtype=bool)
                fresh[1:] = (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1])
                spot, doc = spot[fresh], doc[fresh]
                key = grams[spot]
                did, at = _positions(ids[lo:hi], tags[lo:hi], first, doc, spot)
                order = np.argsort(key, kind="stable")
                key, did, at = key[order], did[order], at[order]
                same = key[1:] == key[:-1]
                known = np.zeros(len(key), dtype=np.int32)
                known[:-1][same] = 1
                known[1:][same] = 2
                away = known == 2
                key[away] = w.mix(at[away].view(np.uint64) ^ did[away].view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.as_long(key)), pa.array(did), pa.array(at), pa.array(known)],
                    names=["key", "did", "at", "known"])
    return run


def _answer_anchors(batches: Batches) -> Batches:
    """(did, at) of anchors with a second occurrence; input sorted by key."""
    held, lit = None, False
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, known = batch.column("key").to_numpy(), batch.column("known").to_numpy()
        hit = known > 0
        same = key[1:] == key[:-1]
        hit[1:] |= same
        hit[:-1] |= same
        if held is not None and lit:
            hit[0] = False   # has been emitted already
            if len(hit) == 1:
                continue
        out = np.flatnonzero(hit)
        if len(out):
            yield batch.select(["did", "at"]).take(pa.array(out))
        lit, held = bool(hit[-1]), batch.slice(len(batch) - 1, 1)


def _per_text(columns: list[str], fold: Callable[[pa.RecordBatch], dict], schema: pa.Schema
              ) -> Callable[[Batches], Batches]:
    """Fold the rows of each (did, tag); input sorted by did, tag, position."""
    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def groups(batch: pa.RecordBatch) -> np.ndarray:
            did = batch.column("did").to_numpy()
            tag = batch.column("at").to_numpy() & LOW
            new = np.ones(len(batch), dtype=bool)
            new[1:] = (did[1:] != did[:-1]) | (tag[1:] != tag[:-1])
            return np.flatnonzero(new)

        def rows(batch: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
            out = [fold(batch.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            if not len(batch):
                continue
            if held:
                last, head = held[-1], batch.slice(0, 1)
                pair = pa.Table.from_batches([last.slice(len(last) - 1, 1), head])
                joined = pair.combine_chunks().to_batches()[0]
                if len(groups(joined)) == 2:   # the held text is complete
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield rows(whole, [0, len(whole)])
                    held = []
            cuts = groups(batch).tolist()
            if held and len(cuts) > 1:
                held.append(batch.slice(0, cuts[1]))
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield rows(whole, [0, len(whole)])
                held, cuts = [], cuts[1:]
            if len(cuts) > 1:
                yield rows(batch, cuts)
            held.append(batch.slice(cuts[-1], len(batch) - cuts[-1]))
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield rows(whole, [0, len(whole)])
    return run


def _anchor_list(batch: pa.RecordBatch) -> dict:
    at = batch.column("at").to_numpy()
    return {"id": batch.column("did")[0].as_py(), "mark": int(at[0] & LOW),
            "spots": np.unique(at >> 32).astype("<i4").tobytes()}


def _index_windows(window: int, gram: int) -> Callable[[Batches], Batches]:
    """Rows (key, did, at, ref, shift): windows to look up, and matches found in a block.

    ``ref`` is NULL for a lookup; a match carries the reference document and how
    far its start lies from the own one.
    """
    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, tags = batch.column("did").to_numpy(), batch.column("tag").to_numpy()
            spots = batch.column("spots")
            for lo, hi, buf, offsets in w.text_blocks(batch.column("text")):
                starts, ends, first = w.find_words(buf, offsets)
                hashes = w.hash_words(buf, starts, ends)
                index, doc, spot, _ = anchors(hashes, first, window, gram)
                marked = np.zeros(len(hashes) + 1, dtype=bool)
                for i in range(hi - lo):
                    own = np.frombuffer(spots[lo + i].as_buffer(), dtype="<i4")
                    marked[own.astype(np.int64) + first[i]] = True
                hit = marked[spot]
                if not hit.any():
                    continue
                index, doc = index[hit], doc[hit]
                key = w.hash_grams(hashes, window)[index]
                did, at = _positions(ids[lo:hi], tags[lo:hi], first, doc, index)
                order = np.lexsort((at, did, key))
                key, did, at = key[order], did[order], at[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = key[1:] != key[:-1]
                head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                # a repetition of the very same place is no earlier occurrence
                later = (did != did[head]) | ((at >> 32) != (at[head] >> 32))
                send = new | ~later
                key = np.where(send, key, w.mix(at.view(np.uint64) ^ did.view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.as_long(key)), pa.array(did), pa.array(at),
                     pa.array(did[head], mask=send),
                     pa.array((at[head] >> 32) - (at >> 32), mask=send)],
                    names=["key", "did", "at", "ref", "shift"])
    return run


def _look_up(batches: Batches) -> Batches:
    """Matches (did, at, ref, shift); input sorted by key, did, at, lookups of a key together."""
    name, home, spot = None, 0, 0
    for batch in batches:
        if not len(batch):
            continue
        key, did, at = (batch.column(c).to_numpy() for c in ("key", "did", "at"))
        done = np.asarray(batch.column("ref").is_valid())
        ask = np.flatnonzero(~done)
        out = [np.flatnonzero(done)]
        ref = batch.column("ref").fill_null(0).to_numpy().copy()
        shift = batch.column("shift").fill_null(0).to_numpy().copy()
        if len(ask):
            k, d, p = key[ask], did[ask], at[ask] >> 32
            new = np.ones(len(ask), dtype=bool)
            new[1:] = k[1:] != k[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(ask)), 0))
            hd, hp = d[head], p[head]
            if name is not None and k[0] == name:   # the key began in an earlier batch
                stop = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(k)
                hd[:stop], hp[:stop] = home, spot
            found = (d != hd) | (p != hp)
            ref[ask], shift[ask] = hd, hp - p
            out.append(ask[found])
            name, home, spot = k[-1], hd[-1], hp[-1]
        rows = np.concatenate(out)
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(did[rows]), pa.array(at[rows]), pa.array(ref[rows]),
                 pa.array(shift[rows])], names=["did", "at", "ref", "shift"])


def _parse(window: int) -> Callable[[pa.RecordBatch], dict]:
    def fold(batch: pa.RecordBatch) -> dict:
        at = batch.column("at").to_numpy()
        pos = at >> 32
        ref, shift = batch.column("ref").to_numpy(), batch.column("shift").to_numpy()
        fresh = np.ones(len(pos), dtype=bool)   # repeated rows match the same places
        fresh[1:] = pos[1:] != pos[:-1]
        pos, ref, shift = pos[fresh], ref[fresh], shift[fresh]
        cut = np.ones(len(pos), dtype=bool)
        cut[1:] = (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])
        head = np.flatnonzero(cut)
        tail = np.append(head[1:], len(pos)) - 1
        return {"id": batch.column("did")[0].as_py(), "mark": int(at[0] & LOW),
                "start": pos[head].tolist(), "length": (pos[tail] - pos[head] + window).tolist(),
                "ref_doc": ref[head].tolist(), "ref_start": (pos[head] + shift[head]).tolist()}
    return fold


def _names() -> tuple[Column, Column]:
    """(did, tag): the document of a text, and its CRC-32."""
    data = F.col("text").cast("string").cast("binary")
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
            F.coalesce(F.crc32(data), F.lit(0)).alias("tag"))


def _attach(texts: DataFrame, table: DataFrame, size: F.Column, how: str) -> DataFrame:
    """Join per-text rows; broadcast only below a checked size, else shuffled."""
    total = table.agg(F.sum(size)).first()[0] or 0
    table = F.broadcast(table) if total <= BROADCAST_BYTES else table
    return texts.join(table, (F.col("did") == F.col("id")) & (F.col("tag") == F.col("mark")), how)


def duplicate_spans(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """Factors of each text of ``docs(doc_id, text)`` that has any.

    Columns: ``id`` (doc_id; NULL as 2**63 - 1), ``mark`` (CRC-32 of the text),
    and the arrays ``start``, ``length`` (in words), ``ref_doc``, ``ref_start``.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    width = shuffle_width(docs.sparkSession)
    texts = docs.select(*_names(), F.col("text").cast("string").alias("text"))
    tag = F.expr("at & 4294967295")
    asked = (texts.mapInArrow(_find_anchors(window, gram), "key long, did long, at long, known int")
             .repartition(width, "key").sortWithinPartitions("key")
             .mapInArrow(_answer_anchors, "did long, at long"))
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("spots", pa.binary())])
    spots = stage(asked.repartition(width, "did", tag).sortWithinPartitions("did", tag, "at")
                  .mapInArrow(_per_text(["did", "at"], _anchor_list, schema),
                              "id long, mark long, spots binary"), "anchors")
    looked = (_attach(texts, spots, F.length("spots") + 40, "inner")
              .select("did", "tag", "text", "spots")
              .mapInArrow(_index_windows(window, gram),
                          "key long, did long, at long, ref long, shift long")
              .repartition(width, "key").sortWithinPartitions("key", "did", "at")
              .mapInArrow(_look_up, "did long, at long, ref long, shift long"))
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()),
                        ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())),
                        ("ref_doc", pa.list_(pa.int64())), ("ref_start", pa.list_(pa.int64()))])
    return stage(looked.repartition(width, "did", tag).sortWithinPartitions("did", tag, "at")
                 .mapInArrow(_per_text(["did", "at", "ref", "shift"], _parse(window), schema),
                             "id long, mark long, start array<long>, length array<long>, "
                             "ref_doc array<long>, ref_start array<long>"), "factors")


def _cut(with_text: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            start, length = batch.column("start"), batch.column("length")
            for lo, hi, buf, offsets in w.text_blocks(w.texts_of(batch)):
                starts, ends, first = w.find_words(buf, offsets)
                edge = np.zeros(len(starts) + 1, dtype=np.int64)
                part = slice(lo, hi)
                a = start[part].combine_chunks() if isinstance(start, pa.ChunkedArray) else start[part]
                b = length[part]
                owner = a.value_parent_indices().to_numpy() if hasattr(
                    a, "value_parent_indices") else None
                if owner is None:
                    owner = np.repeat(np.arange(hi - lo),
                                      [len(x) if x is not None else 0 for x in a.to_pylist()])
                s = a.flatten().to_numpy(zero_copy_only=False) + first[owner]
                np.add.at(edge, s, 1)
                np.add.at(edge, s + b.flatten().to_numpy(zero_copy_only=False), -1)
                keep = np.cumsum(edge[:-1]) <= 0
                out, cuts = w.join_words(buf, starts, ends, first, keep)
                total = np.concatenate(([0], np.cumsum(~keep)))
                data, bounds = out.tobytes(), cuts.tolist()
                digests = [hashlib.sha256(data[x:y]).hexdigest()
                           for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [batch.column("row")[part], pa.array(np.diff(first)),
                           pa.array(total[first[1:]] - total[first[:-1]]), pa.array(digests)]
                if with_text:
                    columns.append(pa.LargeStringArray.from_buffers(
                        hi - lo, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)
                    ).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["row", "n_words", "n_removed", "kept_sha256", "kept"][:len(columns)])
    return run


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 8, with_text: bool = True
                    ) -> DataFrame:
    """``row`` (struct of all columns of ``docs``), n_words, n_removed, kept_sha256, kept.

    Each word is removed that lies in a window of ``window`` consecutive words
    whose sequence also starts earlier: in a document with a smaller doc_id, or
    further left in the same one. ``kept`` joins the other words by one blank
    (``kept_sha256``: SHA-256 of it as lowercase hex). NULL and blank texts have
    no words and keep the empty string. Rows without a doc_id come last and
    count as one document, as do rows that share a doc_id; repeated rows lose
    the same words. Texts shorter than a window stay whole.
    """
    factors = duplicate_spans(docs, window, gram).select("id", "mark", "start", "length")
    out = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    source = with_row(docs, *_names())
    kind = source.schema["row"].dataType.simpleString()
    return (_attach(source, factors, F.size("start") * 16 + 40, "left")
            .drop("did", "tag", "id", "mark")
            .mapInArrow(_cut(with_text), f"row {kind}, {out}"))


def remove_duplicates(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """``docs`` with the duplicate words gone from ``text`` (n_chars follows, if it is there).

    Texts that lose nothing stay as they are, byte by byte.
    """
    found = substring_dedup(docs, window, gram)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    columns = [text.alias("text") if c == "text" else
               F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
               .cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else
               F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5 over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
