r"""BPE encoding and decoding by a tokenization automaton (operator 2).

The automaton reads tokens; its states are "the last token was t" (and a start
state). It starts with one state per byte and an arc from every state for every
byte. Each merge ``x y -> z``, in order, applies one gadget:

1. the new state ``z`` copies the arcs that leave ``y``,
2. the arc labelled ``y`` out of state ``x`` goes (that pair would have merged),
3. every state with an arc ``x`` gets an arc ``z``.

A merge whose path ``x y`` is gone by its turn never applies; its token gets no
arcs and no state, whatever the vocabulary lists.

After all merges the automaton is deterministic and accepts, for every byte
string, exactly one token sequence: its BPE encoding. With 50,000 tokens the
full table would have 2.5 billion entries, so each gadget is stored as what it
did (two copies and one removal, with their times), and an entry is looked up by
following the copies back in time; entries that were used stay in a table.

Encoding walks a pre-split word's bytes through the automaton: for each prefix
there is exactly one accepted last token. Decoding emits the labels of the arcs.

Words are split as the byte-level pre-tokenizer does: contractions, an optional
blank with letters, numbers or other characters, and white space. Character
classes come from one table, so a block of texts is split with a few numpy
passes.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm import words as w
from funnelkit.llm.shared import with_row

Batches = Iterator[pa.RecordBatch]
START = -1
#: entries of a task's word and arc tables before they are emptied
WORDS, ARCS = 1 << 19, 1 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# fixed values: code points that count as white space, and the contractions
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
         0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE] = SPACE
    return table


class Automaton:
    """Gadgets of all merges; ``labels`` are the tokens' bytes by id."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[bytes, bytes]],
                 special: dict[bytes, int] | None = None) -> None:
        self.labels = dict(labels)
        self.special = special or {}
        self.ids = {label: i for i, label in labels.items()}
        self.born = {self.ids[bytes([b])]: -1 for b in range(256) if bytes([b]) in self.ids}
        self.first: dict[int, int] = {}    # column copy: z takes the arcs into its first part
        self.last: dict[int, int] = {}     # row copy: z takes the arcs out of its last part
        self.removed: dict[tuple[int, int], int] = {}
        for time, (x, y) in enumerate(merges):
            self._gadget(time, self.ids[x], self.ids[y], self.ids[x + y])
        self.end = 3 * len(merges) + 3
        #: tokens that the automaton has arcs for, and the longest by their first three bytes
        self.tokens = {label: i for label, i in self.ids.items() if i in self.born}
        self.reach: dict[bytes, int] = {}
        for label in self.tokens:
            for head in (label[:1], label[:2], label[:3]):
                if len(label) <= 3 or len(head) == 3:
                    self.reach[head] = max(self.reach.get(head, 1), len(label))
        self.arcs: dict[int, bool] = {}

    def _gadget(self, time: int, x: int, y: int, z: int) -> None:
        # without a path x, y by now the merge never applies: no arcs to copy, z stays unborn
        if x not in self.born or y not in self.born or not self._look_back(x, y, 3 * time):
            return
        if z in self.born:
            raise ValueError("a token made by two merges is not supported")
        self.last[z], self.first[z] = y, x
        self.removed[x, y] = time
        self.born[z] = time

    def arc(self, state: int, label: int) -> bool:
        """Whether the arc ``label`` leaves ``state``."""
        if state == START:
            return True
        key = state << 32 | label
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._look_back(state, label, self.end)
        return known

    def _look_back(self, state: int, label: int, now: int) -> bool:
        """The arc as it was before step ``now``."""
        # steps of the gadget at time t: row copy 3t, removal 3t + 1, column copy 3t + 2
        while True:
            gone = self.removed.get((state, label))
            if gone is not None and 3 * gone + 1 < now:
                return False
            a, b = self.born[state], self.born[label]
            if a < 0 and b < 0:
                return True
            if a > b:
                now, state = 3 * a, self.last[state]
            else:
                now, label = 3 * b + 2, self.first[label]

    def encode_word(self, word: bytes) -> list[int]:
        tokens, reach, arcs = self.tokens, self.reach, self.arcs
        whole = tokens.get(word)   # born tokens only: the start state has an arc for each
        if whole is not None:
            return [whole]
        n = len(word)
        # longest tokens first: if the automaton accepts that path, it is the only one
        out, at, state = [], 0, START
        while at < n:
            end = min(n, at + reach.get(word[at:at + 3], 2))
            label = tokens.get(word[at:end])
            while label is None and end > at + 1:
                end -= 1
                label = tokens.get(word[at:end])
            if label is None or (at and not self.arc(state, label)):
                break
            out.append(label)
            at, state = end, label
        else:
            return out
        last = [START] * (n + 1)
        for j in range(n):
            state = last[j]
            row = state << 32
            far = j + reach.get(word[j:j + 3], 2)
            for i in range(j + 1, min(n, far) + 1):
                if last[i] == START:   # the longest last token that fits is the only one
                    label = tokens.get(word[j:i])
                    if label is not None:
                        fits = not j or arcs.get(row | label)
                        if fits is None:
                            fits = self.arc(state, label)
                        if fits:
                            last[i] = label
        out = []
        while n:
            if last[n] == START:
                raise ValueError("a byte has no token")
            out.append(last[n])
            n -= len(self.labels[last[n]])
        return out[::-1]


def load_automaton(path: str) -> Automaton:
    """Compile a byte-level BPE ``tokenizer.json``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if (model["type"] != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space") or not split.get("use_regex", True)
            or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
        raise ValueError("only plain byte-level BPE is supported")
    byte = byte_alphabet()
    raw = {s: bytes(byte[c] for c in s) for s in model["vocab"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {}
    for added in spec.get("added_tokens", []):
        if added["single_word"] or added["lstrip"] or added["rstrip"]:
            raise ValueError("added tokens with strip or word rules are not supported")
        special[added["content"].encode()] = added["id"]
    labels = {i: raw[s] for s, i in model["vocab"].items()}
    return Automaton(labels | {i: s for s, i in special.items()},
                     [(raw[x], raw[y]) for x, y in pairs], special)


def split_words(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts, first): pre-split words of each segment; they tile the buffer."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    code = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes[code]
    edge = np.zeros(n + 1, dtype=bool)           # a segment begins here
    cuts = np.searchsorted(lead, offsets)
    edge[cuts] = True
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    blank = code == 0x20
    # white space: the run's last character stands alone unless the run ends the segment
    space = kind == SPACE
    stop = np.flatnonzero(np.append(begin[1:], True) & space) + 1
    inner = ~edge[stop]
    tail = stop[inner] - 1
    begin[tail] = True
    # a blank there is the prefix of the word behind it
    begin[tail[blank[tail]] + 1] = False
    # contractions: an apostrophe that begins a word, alone among letters
    mark = np.flatnonzero((code == 0x27) & begin[:n])
    if len(mark):
        text = np.append(code, [0, 0, 0]).astype(np.int64)
        far = np.append(edge, [True, True, True])
        one = np.isin(text[mark + 1], [ord(c) for c in SHORT]) & ~far[mark + 1]
        two = np.zeros(len(mark), dtype=bool)
        for a, b in LONG:
            two |= (text[mark + 1] == ord(a)) & (text[mark + 2] == ord(b))
        two &= ~far[mark + 1] & ~far[mark + 2] & ~one
        for hit, size in ((mark[one], 2), (mark[two], 3)):
            begin[hit + 1] = False
            rest = hit + size
            rest = rest[rest < n]
            begin[rest] = True
    starts = np.flatnonzero(begin)
    return lead[starts], np.searchsorted(starts, cuts)


def _segments(buf: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]
              ) -> tuple[np.ndarray, dict[int, int]]:
    """Offsets with cuts around special tokens, and {segment: id} of those tokens."""
    data = buf.tobytes()
    hits = []
    for label, number in special.items():
        at = data.find(label)
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(label) <= offsets[doc + 1]:
                hits.append((at, -len(label), number))
                at = data.find(label, at + len(label))
            else:
                at = data.find(label, at + 1)
    if not hits:
        return offsets, {}
    cuts, at, chosen = offsets.tolist(), 0, {}
    for start, size, number in sorted(hits):  # leftmost, then longest
        if start >= at:
            at = start - size
            cuts += [start, at]
            chosen[start] = number
    order = np.unique(np.array(cuts))
    return order, {int(np.searchsorted(order, s)): i for s, i in chosen.items()}


class _Words(dict):
    """Word bytes to its ids as little-endian 32-bit integers."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        out = self[word] = np.array(self.automaton.encode_word(word), dtype="<u4").tobytes()
        return out


class Codec:
    """Encoder and decoder of text blocks."""

    def __init__(self, automaton: Automaton, classes: np.ndarray) -> None:
        self.automaton, self.classes, self.words = automaton, classes, _Words(automaton)
        size = max(automaton.labels) + 1
        parts = [automaton.labels.get(i, b"") for i in range(size)]
        self.width = np.array([len(p) for p in parts], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.width)))[:-1]
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cuts, marks = _segments(buf, offsets, self.automaton.special)
        if len(cuts) == len(offsets):
            cuts = offsets
        starts, first = split_words(buf, cuts, self.classes)
        data = buf.tobytes()
        begin = starts.tolist()
        ids = list(map(self.words.__getitem__,
                       [data[a:b] for a, b in zip(begin, [*begin[1:], len(data)], strict=True)])
                   ) if begin else []
        bounds = first.tolist()
        if not marks:
            return [b"".join(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        pieces = [np.array([marks[k]], dtype="<u4").tobytes() if k in marks else
                  b"".join(ids[bounds[k]:bounds[k + 1]]) for k in range(len(cuts) - 1)]
        own = np.searchsorted(cuts, offsets).tolist()
        return [b"".join(pieces[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of ``ids`` one after another."""
        width = self.width[ids]
        ends = np.cumsum(width)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        at += np.repeat(self.at[ids] - (ends - width), width)
        return self.bytes[at].tobytes()


def _codec(shared) -> Codec:
    """One codec per Python worker; its tables are kept between tasks.

    It hangs on the broadcast value, which a worker drops with its first task
    that does not use it, so later stages do not carry the tables along.
    """
    held = shared.value
    if "codec" not in held:
        held["codec"] = Codec(held["automaton"], held["classes"])
    return held["codec"]


def _encode_batches(shared, full: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        w.release_memory()
        codec = _codec(shared)
        for batch in batches:
            for lo, hi, buf, offsets in w.text_blocks(w.texts_of(batch), 1 << 20):
                blobs = codec.encode(buf, offsets)
                columns = [batch.column("row").slice(lo, hi - lo),
                           pa.array([len(b) // 4 for b in blobs], pa.int64()),
                           pa.array([hashlib.sha256(b).hexdigest() for b in blobs])]
                names = ["row", "n_tokens", "ids_sha256"]
                if full:
                    columns.append(pa.array(
                        [np.frombuffer(b, "<u4").astype(np.int32) for b in blobs],
                        pa.list_(pa.int32())))
                    names.append("ids")
                else:
                    texts = [codec.decode(np.frombuffer(b, "<u4")) for b in blobs]
                    # decode() gives text: bytes that are no UTF-8 become U+FFFD
                    columns.append(pa.array([hashlib.sha256(
                        t.decode("utf-8", "replace").encode()).hexdigest() for t in texts]))
                    names.append("decoded_sha256")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            w.release_memory()
    return run


def _decode_batches(shared) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        codec = _codec(shared)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                known = np.array([i for i in ids or [] if i is not None
                                  and 0 <= i < len(codec.width)], dtype=np.int64)
                texts.append(codec.decode(known).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())],
                                             names=["row", "decoded"])
    return run


def share_automaton(spark: SparkSession, path: str):
    """Compile once on the driver; the broadcast is bounded by the vocabulary file."""
    return spark.sparkContext.broadcast(
        {"automaton": load_automaton(path), "classes": character_classes()})


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True, keep_text: bool = True
                     ) -> DataFrame:
    """``row`` (struct of all columns), n_tokens, ids_sha256 and ``ids`` of each ``text``.

    Without ``with_ids`` the text is decoded again and ``decoded_sha256`` stands
    in place of ``ids``; without ``keep_text`` the struct lacks the text. NULL
    texts are empty and have no tokens. Whole texts are encoded, of any length;
    strings of added tokens in a text become those tokens. Rows are independent:
    ties and repeated rows give repeated results.
    """
    if keep_text:
        source = with_row(docs)
    else:
        others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
        source = docs.select(others.alias("row"), F.col("text").cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    last = "ids array<int>" if with_ids else "decoded_sha256 string"
    return source.mapInArrow(_encode_batches(share_automaton(docs.sparkSession, path), with_ids),
                             f"row {kind}, n_tokens long, ids_sha256 string, {last}")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """``row`` (struct of all columns) and ``decoded`` of each ``ids``; unknown ids are skipped."""
    source = tokens.select(F.struct("*").alias("row"),
                           F.col("ids").cast("array<int>").alias("ids"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(_decode_batches(share_automaton(tokens.sparkSession, path)),
                             f"row {kind}, decoded string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per document."""
    found = encode_documents(docs.select("doc_id", "text"), path or tokenizer_path(),
                             with_ids=False, keep_text=False)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256",
                        "decoded_sha256")


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over all ``documents``."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
