"""Base spans against the patterns as written, the model on held-out spellings, edge cases."""

import random
import re
import time

import numpy as np
import pytest

from funnelkit.llm import pii
from funnelkit.llm.pii import (KINDS, Tagger, added_spans, base_spans, find_personal_data,
                               labelled_windows, luhn, reconcile, training_set, window_starts)
from tests.conftest import SF_SMALL

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    windows = labelled_windows(docs)
    assert windows == labelled_windows(docs.repartition(5))   # whatever the partitions
    tagger = Tagger()
    losses = tagger.fit(*training_set(windows))
    assert losses[-1] < losses[0] / 5
    tagger.windows = windows
    return tagger


def test_base_equals_patterns_on_random_texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "1", "255", "256", "10.0.0.1", " ", "-", "+", "4111111111111111",
             "+1 (555) 123-4567", "x@y.z", "%", "..", "é", "\n", "(", ")", "00", "4111 1111 1111 1111"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert base_spans(text) == plain(text), text


def test_base_equals_patterns_on_documents(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    assert [base_spans(t) for t in texts] == [plain(t) for t in texts]
    assert sum(map(len, map(base_spans, texts))) > 5


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "@", "a@", "+1", "(", "a.b-", "+1 ", "[at]", "1234 5678 "])
def test_long_runs_take_linear_time(unit):
    start = time.process_time()
    base_spans(unit * (400_000 // len(unit)))
    window_starts(unit * (400_000 // len(unit)))
    assert time.process_time() - start < 10


def test_gradients_are_those_of_the_loss():
    tagger = Tagger(hidden=3, seed=1)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 99, (3, 7))
    tags = np.zeros((3, 7), np.int64)
    tags[0, 2:5] = [1, 2, 2]
    tags[1, 1:3] = [5, 6]
    _, grad = tagger.gradients(ids, tags)
    for name, w in tagger.weights.items():
        for _ in range(4):
            at = (1, int(ids[0, 3]), 2) if name == "inp" else tuple(int(rng.integers(s)) for s in w.shape)
            if name == "move" and not pii.ALLOWED[at]:
                continue
            old, eps = w[at], 1e-2
            w[at] = old + eps
            up = tagger.gradients(ids, tags)[0]
            w[at] = old - eps
            down = tagger.gradients(ids, tags)[0]
            w[at] = old
            assert abs((up - down) / (2 * eps) - grad[name][at]) < 2e-2, name


def test_viterbi_is_the_best_legal_path():
    tagger = Tagger(hidden=2, seed=3)
    ids = np.random.default_rng(1).integers(0, 99, (5, 4))
    tags, _ = tagger.decode(ids)
    _, emit, _ = tagger._run(ids, False)
    move = tagger._moves()
    import itertools
    for n in range(5):
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda p: (
            (0 if pii.START[p[0]] else -1e4) + sum(emit[t, n, p[t]] for t in range(4))
            + sum(move[a, b] for a, b in zip(p, p[1:]))))
        assert tuple(tags[n]) == best


def test_held_out_spellings(model):
    ids, tags = training_set(model.windows, copies=1, seed=77)   # other made spans
    held = slice(len(model.windows), None)
    got, _ = model.decode(ids[held])
    assert (got == tags[held]).mean() > 0.96
    assert (got == tags[held]).all(axis=1).mean() > 0.75


def test_adds_spellings_and_leaves_clean_texts_alone(model):
    rng = np.random.default_rng(5)
    total = hits = 0
    for kind in KINDS:
        for _ in range(40):
            span = pii._made(kind, rng)
            text = f"please note {span} , thank you"
            own = base_spans(text)
            if own:
                continue
            total += 1
            hits += any(a < 12 + len(span) and b > 12 for a, b, _ in added_spans([text], [own], model)[0])
    assert total > 40 and hits >= 0.6 * total
    clean = ["It was 1998, at 10:30, 12. May", "section 3.2.1 of v1.2.3.4.5 costs $1,234.56",
             "look at the dot on the wall", "deadbeef 9f8e7d6c5b4a39281706 key"]
    assert added_spans(clean, [base_spans(t) for t in clean], model) == [[]] * 4


def test_reconcile_joins_pieces_and_takes_the_best_set():
    assert reconcile([(0, 10, "ip", 1.0), (5, 15, "ip", 2.0)]) == [(0, 15, "ip")]
    assert reconcile([(0, 10, "ip", 3.0), (8, 20, "card", 4.0), (20, 25, "ip", 2.0)]) == [
        (8, 20, "card"), (20, 25, "ip")]
    assert reconcile([(0, 10, "ip", 3.0), (8, 20, "card", 4.0), (15, 25, "ip", 2.0)]) == [
        (0, 10, "ip"), (15, 25, "ip")]
    assert reconcile([]) == []


def test_windows_cover_every_sign():
    text = "x" * 200 + "7" + "y" * 300 + "@" + "z" * 10
    for at in (200, 501):
        assert sum(s <= at < s + pii.WIDTH for s in window_starts(text)) == 2
    assert window_starts("no sign here") == []


def test_rows_of_every_sort(spark, model):
    long = "word " * 100_000 + "a.b@c.de" + " word" * 100_000
    rows = [(1, None), (2, ""), (3, long), (4, "1.2.3.4"), (4, "1.2.3.4"), (None, "+49 (30) 123-4567"),
            (6, "é 4111 1111 1111 1111 1.2.3.256")]
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, kind string, spans int")
    got = find_personal_data(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        own = plain(dict([(i, t) for i, t in rows])[r["doc_id"]])
        text = pii.span_text(own)
        from hashlib import sha256
        assert r["base_sha256"] == sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in own) for k in KINDS]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert find_personal_data(empty, model).collect() == []
    assert labelled_windows(empty) == []
