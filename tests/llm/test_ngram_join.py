import random
import re

import numpy as np
import pyarrow as pa
import pytest

from funnelkit.llm import ngram_join as nj
from funnelkit.llm import words as w

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, k=5):
    ws = WORD.findall(lower(text or ""))
    if not ws:
        return frozenset()
    if len(ws) < k:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups.get(root(i), []) if x is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min(ids) if ids and ids[0] is not None or ids else None))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(25)]
    rows, texts = [], []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.45:
            ws = WORD.findall(rnd.choice(texts))
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                if ws:
                    at = rnd.randrange(len(ws))
                    if rnd.random() < 0.5:
                        ws[at] = rnd.choice(vocab)
                    else:
                        del ws[at]
        else:
            ws = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 4, 5, 6, 8, 12, 30, 90, 250]))]
            if kind > 0.8:
                ws[len(ws) // 2:len(ws) // 2] = passage
        text = rnd.choice([" ", "\n", "\t "]).join(ws)
        if rnd.random() < 0.2:
            text = text.upper()
        texts.append(text)
        rows.append((i * 3 + 1, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(9001, None), (9002, ""), (9003, " \n"), (None, rows[5][1]), (None, "only here now and then"),
             rows[7], rows[7], (5000, rows[60][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r)[:3] for r in nj.ngram_join(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_blocks_and_second_round(spark, monkeypatch):
    """Chains whose ends only meet through a middle text, with tiny tiles."""
    monkeypatch.setattr(nj, "TILE_SETS", 3)
    rnd = random.Random(5)
    rows = []
    for c in range(6):
        ws = [f"c{c}x{i}" for i in range(60)]
        for step in range(12):
            rows.append((c * 100 + rnd.randrange(99), " ".join(ws)))
            ws = ws[2:] + [f"c{c}y{step}a", f"c{c}y{step}b"]
    rows = list({d: (d, t) for d, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([tuple(r)[:3] for r in nj.ngram_join(df).collect()], key=str)
    assert got == brute(rows)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node string, hub int")
    assert nj.ngram_join(df).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2)],
                               "doc_id long, text string, node string, hub int")
    assert sorted(r[:3] for r in nj.ngram_join(df).collect()) == [(1, 2, 1), (2, 2, 1)]
    kept = nj.keep_one(df.union(df)).collect()
    assert [tuple(r) for r in kept] == [(1, "a b c d e f", "x", 1)]


def test_keep_one_of_rows_that_share_an_id(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(3, x), (7, x), (7, y), (9, y + " more"), (7, ""), (4, "v " + x), (4, "u " + x),
            (11, "p q r s t u"), (11, "P q r s t u"), (12, "k l m n o p")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((d, t.lower()) for d, t in nj.keep_one(df).collect())
    assert kept == [(3, x), (7, ""), (7, y), (11, "p q r s t u"), (12, "k l m n o p")]
    near = spark.createDataFrame([(5, "v " + x), (5, "u " + x), (5, y)], "doc_id long, text string")
    assert sorted(t[-3:] for _, t in nj.keep_one(near).collect()) == ["x39", "y39"]


@pytest.mark.parametrize("size", [1, 2, 4, 5, 7, 11, 40, 300, 2000])
def test_similar_sets_share_a_signature(size):
    """The guarantee itself, on pairs exactly at the threshold."""
    rng = np.random.default_rng(size)
    tops = nj.band_tops(80, 4000)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, size=size, dtype=np.uint64))
        grow = int(rng.integers(0, len(a) // 4 + 1))
        cut = 0
        while 10 * (len(a) - cut - 1) >= 8 * (len(a) + grow) and rng.random() < 0.8:
            cut += 1
        b = np.unique(np.concatenate((a[cut:], rng.integers(0, 2**63, size=grow, dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * common < 80 * (len(a) + len(b) - common):
            continue
        sa = {c: (need, set(s.tolist())) for c, need, s in nj.signatures(a, 80, tops)}
        sb = {c: (need, set(s.tolist())) for c, need, s in nj.signatures(b, 80, tops)}
        assert any(len(sa[c][1] & sb[c][1]) >= max(sa[c][0], sb[c][0], 1) for c in sa.keys() & sb.keys())


def test_word_kernel_on_long_words_and_blocks():
    long = "x" * 200_000
    texts = ["", None, "a " + long + " b", long, "tab\tnew\nline\x0bvt\x0cff\rcr nbsp x", "é ü 漢字 😀"] * 3
    column = pa.array(texts)
    for limit in (1, 100, 1 << 20):
        at, hashes = 0, {}
        for lo, hi, buf, off in w.text_blocks(column, limit):
            assert lo == at
            at = hi
            s, e, first = w.find_words(buf, off)
            h = w.hash_words(buf, s, e)
            for i in range(hi - lo):
                words = WORD.findall(texts[lo + i] or "")
                span = range(first[i], first[i + 1])
                assert [bytes(buf[s[x]:e[x]]).decode() for x in span] == words
                for x, word in zip(span, words, strict=True):
                    assert hashes.setdefault(word, h[x]) == h[x]
        assert at == len(texts) and len(set(hashes.values())) == len(hashes)
