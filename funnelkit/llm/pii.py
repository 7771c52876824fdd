"""Personal data: a character BiLSTM with CRF transitions over overlapping windows (operator 13).

Base spans (email, ip, card, phone) come from fixed patterns, applied here in
linear time to whole texts. The model adds the spellings that they miss: spelled
at signs and dots, bracketed addresses, cards with other separators, phone
numbers without a plus sign.

* **Labelled spans**: at most ``SNIPPETS`` windows per kind (and as many with
  digits but no span), the first by hash, taken from all documents around base
  spans; each also teaches rewritten spellings of its span, and decoys (dates,
  versions, amounts). A kind that the corpus lacks is taught from made spans.
* **Model**: both directions run in one numpy loop, emissions of BIO tags feed a
  linear-chain CRF; log-likelihood gradients by forward-backward, Adam. Training
  is seeded and bounded, and takes place once per query in the driver; its
  weights (about 100 kB) travel in the task closure.
* **Windows** of ``WIDTH`` characters start every ``STEP``, so a span of up to
  ``WIDTH - STEP`` characters lies whole in one. Every window that holds a digit
  or an at sign (spelled ones too) is decoded; a span without either is none of
  the four kinds, so other windows cannot add one.
* **Reconciliation**: pieces of one kind that touch across windows join, then a
  document's best set of disjoint spans (weighted interval scheduling over all
  its windows) stays if it passes an exact check of its kind (four parts of at
  most 255, Luhn, digit counts, an address around the at sign) and touches no
  base span.

Defined results: NULL and empty texts have no spans; rows are judged one by one,
so repeated rows agree; an empty table gives no rows; a long text is windowed in
blocks, memory beyond the text itself is that of one block; other columns are
not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WIDTH, STEP = 80, 40
#: labelled windows of each kind (and of none) that train the model
SNIPPETS = 300
HIDDEN = 16
EPOCHS = 12
#: windows decoded together
BLOCK = 1024

Span = tuple[int, int, str]

# ------------------------------------------------------------------ base spans
# fixed values: the patterns of the contract; runs are possessive, so that no
# digit run is tried again from its middle
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done, "email"
            at = text.find("@", done)
        else:
            done = max(done, at + 1)   # no later match reaches over this sign
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[Span]:
    """The contract's spans, by start, then kind as listed."""
    if not text:
        return []
    found = list(_emails(text))
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# ------------------------------------------------------------------ the model
TAGS = 1 + 2 * len(KINDS)   # O, then B and I of each kind
#: no tag I without its B or I before it
ALLOWED = np.array([[t % 2 == 1 or t == 0 or (s and (s + 1) // 2 == t // 2) for t in range(TAGS)]
                    for s in range(TAGS)])
START = np.array([t % 2 == 1 or t == 0 for t in range(TAGS)])
_NEVER = -1e4
_SYMBOLS = 100


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII as itself (digits alike), then classes; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = np.where((points >= 32) & (points < 127), points.astype(np.int64) - 31, 96)
    ids[(points >= 48) & (points <= 57)] = 97
    for i in np.flatnonzero(points > 127):
        c = text[i]
        ids[i] = 97 if c.isdecimal() else 98 if c.isalpha() else 99
    return ids


class Tagger:
    """BiLSTM-CRF weights as numpy arrays, its training step and its decoder."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = hidden

        def some(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)
        # input tables hold a character's share of all four gates, per direction
        self.weights = {"inp": some(2, _SYMBOLS, 4 * h, scale=0.2),
                        "rec": some(2, h, 4 * h, scale=h**-0.5),
                        "out": some(2 * h, TAGS, scale=(2 * h)**-0.5),
                        "bias": np.zeros(TAGS, np.float32),
                        "move": np.zeros((TAGS, TAGS), np.float32)}
        self.weights["inp"][:, :, h:2 * h] += 1.0   # remember at first
        self.hidden = h

    def _run(self, ids: np.ndarray, keep: bool):
        h, w = self.hidden, self.weights
        both = np.stack([ids, ids[:, ::-1]])
        n, steps = ids.shape
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.empty((steps, 2, n, h), np.float32)
        gates, cells = [], []
        for t in range(steps):
            z = np.stack([w["inp"][d][both[d, :, t]] for d in (0, 1)])
            z += state @ w["rec"]
            z[..., :3 * h] *= 0.5
            np.tanh(z, out=z)
            z[..., :3 * h] += 1.0
            z[..., :3 * h] *= 0.5    # input, forget, output gates; then the candidate
            cell = z[..., h:2 * h] * cell + z[..., :h] * z[..., 3 * h:]
            state = z[..., 2 * h:3 * h] * np.tanh(cell)
            out[t] = state
            if keep:
                gates.append(z)
                cells.append(cell)
        joined = np.concatenate((out[:, 0], out[::-1, 1]), axis=2)   # steps, n, 2h
        return joined, joined @ w["out"] + w["bias"], (both, out, gates, cells)

    def _moves(self) -> np.ndarray:
        return np.where(ALLOWED, self.weights["move"], _NEVER).astype(np.float32)

    def gradients(self, ids: np.ndarray, tags: np.ndarray):
        """(mean negative log-likelihood per window, gradient of each weight)."""
        h, w = self.hidden, self.weights
        joined, emit, (both, out, gates, cells) = self._run(ids, True)
        n, steps = ids.shape
        move, gold = self._moves(), tags.T
        first = np.where(START, 0.0, _NEVER).astype(np.float32)

        def lse(x, axis):
            top = x.max(axis=axis, keepdims=True)
            return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0] + first
        for t in range(1, steps):
            ahead[t] = lse(ahead[t - 1][:, :, None] + move, 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = lse(move + (emit[t + 1] + behind[t + 1])[:, None, :], 2)
        total = lse(ahead[-1], 1)
        at, row = np.arange(steps)[:, None], np.arange(n)[None, :]
        score = emit[at, row, gold].sum(0) + move[gold[:-1], gold[1:]].sum(0)
        d_emit = np.exp(ahead + behind - total[None, :, None])
        d_move = np.zeros((TAGS, TAGS), np.float32)
        for t in range(1, steps):
            d_move += np.exp(ahead[t - 1][:, :, None] + move + (emit[t] + behind[t])[:, None, :]
                             - total[:, None, None]).sum(0)
        np.subtract.at(d_move, (gold[:-1].ravel(), gold[1:].ravel()), 1.0)
        d_emit[at, row, gold] -= 1.0
        grad = {"move": np.where(ALLOWED, d_move, 0.0), "bias": d_emit.sum((0, 1)),
                "out": np.tensordot(joined, d_emit, ((0, 1), (0, 1)))}
        d_join = d_emit @ w["out"].T
        d_out = np.stack([d_join[..., :h], d_join[::-1, :, h:]], axis=1)
        d_state, d_cell = np.zeros_like(out[0]), np.zeros_like(out[0])
        d_rec, d_z = np.zeros_like(w["rec"]), np.empty((steps, 2, n, 4 * h), np.float32)
        back = w["rec"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (gates[t][..., k * h:(k + 1) * h] for k in range(4))
            d = d_out[t] + d_state
            tc = np.tanh(cells[t])
            d_cell = d_cell + d * o * (1 - tc * tc)
            before = cells[t - 1] if t else np.zeros_like(tc)
            z = d_z[t]
            z[..., :h] = d_cell * g * i * (1 - i)
            z[..., h:2 * h] = d_cell * before * f * (1 - f)
            z[..., 2 * h:3 * h] = d * tc * o * (1 - o)
            z[..., 3 * h:] = d_cell * i * (1 - g * g)
            if t:
                d_rec += out[t - 1].transpose(0, 2, 1) @ z
            d_cell = d_cell * f
            d_state = z @ back
        grad["rec"] = d_rec
        d_inp = np.zeros_like(w["inp"])
        for d in (0, 1):
            flat = both[d].T.ravel()
            order = np.argsort(flat, kind="stable")
            cut = np.flatnonzero(np.diff(flat[order], prepend=-1))
            d_inp[d][flat[order][cut]] = np.add.reduceat(d_z[:, d].reshape(-1, 4 * h)[order], cut)
        grad["inp"] = d_inp
        return float((total - score).mean()), {k: v / n for k, v in grad.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = 128,
            rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over shuffled batches, its rate falling to nothing; the loss of each epoch."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses, step, last = [], 0, epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, total = rng.permutation(len(ids)), 0.0
            for a in range(0, len(ids), batch):
                pick = order[a:a + batch]
                loss, grad = self.gradients(ids[pick], tags[pick])
                total += loss * len(pick)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.weights[k] -= ((rate * (1 - (step - 1) / last)) * (mean[k] / (1 - 0.9**step))
                                        / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                                        ).astype(np.float32)
            losses.append(total / max(1, len(ids)))
        return losses

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best tags, lead of each tag's emission over O) of every window, by Viterbi."""
        _, emit, _ = self._run(ids, False)
        steps, n, _ = emit.shape
        move = self._moves()
        best = emit[0] + np.where(START, 0.0, _NEVER)
        came = np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + move
            came[t] = paths.argmax(1)
            best = paths.max(1) + emit[t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = best.argmax(1)
        row = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = came[t][row, tags[:, t]]
        lead = emit[np.arange(steps)[None, :], row[:, None], tags] - emit[:, :, 0].T
        return tags, lead


# ------------------------------------------------------------------ windows
_SIGN = re.compile(r"[\d@＠]|[(\[{]at[)\]}]|\bat\b.{1,40}?\bdot\b", re.IGNORECASE)


def window_starts(text: str) -> list[int]:
    """Starts of the windows (every ``STEP``) that hold a digit or an at sign."""
    starts: list[int] = []
    for m in _SIGN.finditer(text):
        last = m.start() // STEP
        for k in (last - 1, last):
            if k >= 0 and (not starts or k * STEP > starts[-1]):
                starts.append(k * STEP)
    return starts


def _runs(tags: np.ndarray, lead: np.ndarray, start: int) -> Iterator[tuple[int, int, str, float]]:
    i, n = 0, len(tags)
    while i < n:
        if tags[i] == 0:
            i += 1
            continue
        kind = (int(tags[i]) - 1) // 2
        j = i + 1
        while j < n and tags[j] == 2 * kind + 2:
            j += 1
        yield start + i, start + j, KINDS[kind], float(lead[i:j].sum())
        i = j


def reconcile(pieces: list[tuple[int, int, str, float]]) -> list[Span]:
    """The disjoint spans of the largest summed score; pieces of one kind that overlap join first."""
    joined: list[tuple[int, int, str, float]] = []
    for kind in KINDS:
        for a, b, _, s in sorted(p for p in pieces if p[2] == kind):
            if joined and joined[-1][2] == kind and a < joined[-1][1]:
                c, d, _, r = joined.pop()
                joined.append((c, max(b, d), kind, max(s, r)))
            else:
                joined.append((a, b, kind, s))
    joined = sorted((p for p in joined if p[3] > 0), key=lambda p: (p[1], p[0], KINDS.index(p[2])))
    ends = [p[1] for p in joined]
    best: list[tuple[float, int]] = [(0.0, 0)]   # (score, 1 if the span is taken)
    fits = np.searchsorted(ends, [p[0] for p in joined], side="right").tolist()
    for i, p in enumerate(joined):
        taken = best[fits[i]][0] + p[3]
        best.append((taken, 1) if taken > best[i][0] else (best[i][0], 0))
    out, i = [], len(joined)
    while i > 0:
        if best[i][1]:
            a, b, kind, _ = joined[i - 1]
            out.append((a, b, kind))
            i = fits[i - 1]
        else:
            i -= 1
    return out[::-1]


_AT = re.compile(r"\s*(?:@|＠|[(\[{]at[)\]}]|\bat\b)\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*(?:[(\[{](?:dot|\.)[)\]}]|\bdot\b)\s*", re.IGNORECASE)
_ADDRESS = re.compile(r"[^\s@,;:!?()\[\]{}]+@[^\s@.,;:!?()\[\]{}]+(?:\.[^\s@.,;:!?()\[\]{}]+)+")


def plausible(kind: str, text: str) -> bool:
    """The exact check of an added span."""
    if kind == "email":
        return _ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", text))) is not None
    digits = "".join(str(int(c)) for c in text if c.isdecimal())
    if kind == "ip":
        parts = re.findall(r"\d+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if any(c.isalpha() for c in text):
        return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and (digits.startswith("00") or not text.isdecimal())


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def _union(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that the spans cover, disjoint and ascending."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def added_spans(texts: list[str], base: list[list[Span]], model: Tagger) -> list[list[Span]]:
    """What the model adds to each text's base spans."""
    pieces: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    todo: list[tuple[int, int]] = []

    def flush() -> None:
        ids = np.zeros((len(todo), WIDTH), np.int64)
        for row, (doc, start) in enumerate(todo):
            part = char_ids(texts[doc][start:start + WIDTH])
            ids[row, :len(part)] = part
        tags, lead = model.decode(ids)
        for row in np.flatnonzero(tags.any(axis=1)):
            doc, start = todo[row]
            pieces[doc].extend(_runs(tags[row], lead[row], start))
        todo.clear()
    for doc, text in enumerate(texts):
        for start in window_starts(text):
            todo.append((doc, start))
            if len(todo) == BLOCK:
                flush()
    if todo:
        flush()
    out = []
    for text, own, found in zip(texts, base, pieces, strict=True):
        taken, at, more = _union(own), 0, []
        for a, b, kind in reconcile(found):
            a, b = _trimmed(text, a, b)
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            clash = at < len(taken) and taken[at][0] < b
            whole = not (text[a - 1:a].isalnum() or text[b:b + 1].isalnum())
            if a < b and whole and not clash and plausible(kind, text[a:b]):
                more.append((a, b, kind))
        out.append(more)
    return out


# ------------------------------------------------------------------ labelled windows

def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled windows of each text: one around every base span, one at other digits."""
    for batch in batches:
        kinds, snippets, spans = [], [], []
        for text in batch.column("text").to_pylist():
            if not text or not re.search(r"[0-9@]", text):
                continue
            own = base_spans(text)
            marks = [(a, kind) for a, _, kind in own]
            for m in re.finditer(r"[0-9]++", text):
                if not any(a <= m.start() < b for a, b, _ in own[:64]):
                    marks.append((m.start(), "none"))
                    break
            for a, kind in marks[:8]:
                lo = max(0, a - 30)
                kinds.append(kind)
                snippets.append(text[lo:lo + WIDTH])
                spans.append(span_text([(x - lo, min(y - lo, WIDTH), k) for x, y, k in own
                                        if lo <= x < lo + WIDTH]))
        yield pa.RecordBatch.from_pydict({"kind": kinds, "snippet": snippets, "spans": spans},
                                         pa.schema([(c, pa.string()) for c in ("kind", "snippet", "spans")]))


def labelled_windows(docs: DataFrame, each: int = SNIPPETS) -> list[tuple[str, str, str]]:
    """At most ``each`` (kind, window, spans) of every kind and of none, first by hash."""
    cut = docs.select(F.col("text").cast("string").alias("text")).where(
        F.col("text").rlike("[0-9@]")).mapInArrow(_cuts, "kind string, snippet string, spans string")
    order = Window.partitionBy("kind").orderBy(F.xxhash64("snippet"), "snippet", "spans")
    picked = cut.groupBy("kind", "snippet", "spans").count().withColumn(
        "i", F.row_number().over(order)).where(F.col("i") <= each)
    return sorted((r["kind"], r["snippet"], r["spans"]) for r in picked.collect())


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _luhned(rng, n: int) -> str:
    body = _digits(rng, n - 1)
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _made(kind: str, rng) -> str:
    """A made span of ``kind`` in one of many spellings."""
    def pick(*options):
        return options[rng.integers(len(options))]

    def word(lo=2, hi=9):
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi)))
    if kind == "email":
        local = word() + pick("", ".", "_", "-") + pick("", word(), _digits(rng, 2))
        at = pick("@", "@", " @ ", " (at) ", "(at)", " [at] ", "[at]", " at ")
        dot = pick(".", ".", " (dot) ", "[dot]", " [dot] ", "(dot)", " dot ")
        if at == " at ":
            dot = " dot "
        return local.strip("._-") + at + dot.join(
            [word() + pick("", _digits(rng, 1)), *([word()] if rng.random() < 0.5 else []),
             pick("com", "org", "net", "de", "fr", "example", "io")])
    if kind == "ip":
        return pick(".", ".", "[.]", "(.)", " . ", "[dot]").join(
            str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        number = _luhned(rng, pick(16, 16, 15, 13, 19))
        sep = pick("", " ", "-", ".", "/", "_", "  ", " - ")
        return sep.join(number[i:i + 4] for i in range(0, len(number), 4))
    a, b, c, cc = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), str(rng.integers(1, 99))
    return pick(f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
                f"{a}.{b}.{c}", f"00{cc} {a} {b} {c}", f"00{cc}-{a}-{b}{c}", f"{a}/{b}{c}",
                f"0{a} {b} {c}", f"00{cc}{a}{b}{c}")


def _decoy(rng) -> str:
    d = _digits(rng, 14)
    options = (f"20{d[:2]}-0{d[2]}-1{d[3]}", f"{d[:2]}/{d[2:4]}/19{d[4:6]}", f"1{d[0]}:{d[1:3]}", f"{d[0]}.{d[1]}.",
               f"v{d[0]}.{d[1]}.{d[2]}", f"${d[:1]},{d[1:4]}.{d[4:6]}", f"#{d[:5]}", f"{d[:3]}", f"{d[:8]}",
               f"{d[:3]} {d[3:6]}", f"{d[:2]}%", f"§{d[:2]}.{d[2]}", f"x{d[:6]}f", f"at {d[0]} dot", f"{d[:4]}-{d[4:8]}",
               f"{d[0]}a{d[1:3]}f{d[3:5]}bc{d[5:9]}e{d[9:]}", f"[{d[:2]}]", f"({d[:4]})", f"{d[:1]}.{d[1:5]}e{d[5]}")
    return options[rng.integers(len(options))]


def training_set(windows: list[tuple[str, str, str]], copies: int = 2, seed: int = 3
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(character ids, tags) of the labelled windows and of their rewritten spellings."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, list[Span]]] = []
    plain = [re.sub(r"[\d@]", "", s) for _, s, _ in windows] or ["", "write to us or call now. "]
    for _, snippet, spans in windows:
        own = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
        flat, end = [], 0
        for a, b, k in own:   # overlapping base spans: the first one teaches
            if a >= end and b - a > 1:
                flat.append((a, b, k))
                end = b
        rows.append((snippet, flat))
    per_kind = max(SNIPPETS, 1) * copies
    for kind in (*KINDS, "none", "none"):
        for _ in range(per_kind):
            context = plain[rng.integers(len(plain))]
            at = int(rng.integers(0, 45))
            blank = context.find(" ", at)
            head = context[:blank + 1 if 0 <= blank < 50 else min(at, len(context))]
            if head and not head.endswith(" "):
                head += " "
            if rng.random() < 0.3:
                head = (head[:25] + " " + _decoy(rng) + " ").lstrip()
            span = _decoy(rng) if kind == "none" else _made(kind, rng)
            tail = ("", " ", ", ", ". ", "; ", ") ", "!! ", "\n")[rng.integers(8)]
            rest = context[len(head):]
            if rng.random() < 0.3:
                rest = " " + _decoy(rng) + " " + rest
            text = head + span + (tail + rest if tail else "")
            labels = [] if kind == "none" else [(len(head), len(head) + len(span), kind)]
            shift = int(rng.integers(0, max(1, len(head)))) if rng.random() < 0.3 else 0
            rows.append((text[shift:], [(a - shift, b - shift, k) for a, b, k in labels]))
    ids, tags = np.zeros((len(rows), WIDTH), np.int64), np.zeros((len(rows), WIDTH), np.int64)
    for i, (text, spans) in enumerate(rows):
        part = char_ids(text[:WIDTH])
        ids[i, :len(part)] = part
        for a, b, k in spans:
            tags[i, a:b] = 2 * KINDS.index(k) + 2
            tags[i, a:a + 1] = 2 * KINDS.index(k) + 1
    return ids, tags


def train(docs: DataFrame, each: int = SNIPPETS, epochs: int = EPOCHS) -> Tagger:
    model = Tagger()
    model.fit(*training_set(labelled_windows(docs, each)), epochs=epochs)
    return model


# ------------------------------------------------------------------ the operator
_OUT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "spans string, n_added long, added string")


def find_personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base counts and digest, all spans, the added ones.

    ``n_<kind>`` count base spans; ``spans`` and ``added`` read ``kind:start:end``,
    by start, then kind, joined by commas.
    """
    model = model or train(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model)
                every = [sorted(a + b, key=lambda s: (s[0], KINDS.index(s[2])))
                         for a, b in zip(base, more, strict=True)]
                counts = [pa.array([sum(k == kind for _, _, k in b) for b in base], pa.int64())
                          for kind in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *counts,
                     pa.array([sha256(span_text(b).encode()).hexdigest() for b in base], pa.string()),
                     pa.array([span_text(s) for s in every], pa.string()),
                     pa.array([len(m) for m in more], pa.int64()),
                     pa.array([span_text(m) for m in more], pa.string())],
                    names=[c.split()[0] for c in _OUT.split(", ")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(scan, _OUT)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 13 over all ``documents``."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
