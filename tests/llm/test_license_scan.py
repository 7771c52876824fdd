import random
import re

import pytest

from funnelkit.llm import license_scan as ls

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def grams(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


def brute(text, contain=0.8):
    own = grams(text)
    return {n for n, t in ls.TEMPLATES.items() if len(grams(t) & own) >= contain * len(grams(t))}


def test_notices_are_found(spark):
    rnd = random.Random(4)
    vocab = ["le", "of", "und", "license", "the", "free", "version", "é", "12"] + [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        ws = [rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 40, 400]))]
        for name in rnd.sample(sorted(ls.TEMPLATES), rnd.choice([0, 0, 1, 2])):
            notice = ls.TEMPLATES[name].split()
            if len(notice) > 20 and rnd.random() < 0.5:
                notice[rnd.choice([0, 1, -1])] = "zzz"
            if rnd.random() < 0.2:
                notice = [x.upper() for x in notice]
            ws += notice + [rnd.choice(vocab) for _ in range(rnd.choice([0, 5, 60]))]
        rows.append((i, rnd.choice([" ", "\n", " - "]).join(ws)))
    rows += [(900, None), (901, ""), rows[4], rows[4], (None, ls.TEMPLATES["MIT-line"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ls.scan_licenses(df).select("row.doc_id", "license", "containment").collect()
    found = sorted([(r.doc_id, r.license) for r in got], key=str)
    want = sorted([(d, n) for d, t in rows for n in brute(t)], key=str)
    assert set(found) <= set(want)
    assert len(want) > 80 and len(found) >= 0.99 * len(want)
    assert all(0.8 <= r.containment <= 1 for r in got)


def test_windows_and_own_templates(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    notice = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text + notice + " " + text)], "doc_id long, text string")
    templates = spark.createDataFrame([("n", notice), ("n", "too short"), (None, None)],
                                      "name string, text string")
    [row] = ls.scan_licenses(df, templates).collect()
    assert row.license == "n" and row.containment == 1.0
    assert row.window_start <= 78 <= row.window_start + row.window_words - 10
    assert ls.scan_licenses(df, templates.limit(0)).collect() == []


def test_certainty_of_bands():
    for s in (0.2, 0.5, 0.9):
        b = ls.band_count(s, 0.999)
        assert 1 - (1 - s**ls.ROWS) ** b >= 0.999
    for group in ls.length_classes(sorted(ls.TEMPLATES.items()), 0.8, 0.999):
        assert group.bands >= ls.band_count(group.similarity, 0.999)


def test_empty_and_extra_columns(spark):
    schema = "doc_id long, text string, license int, row string"
    assert ls.scan_licenses(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, ls.TEMPLATES["MIT-line"], 3, "r")], schema)
    [got] = ls.scan_licenses(df).collect()
    assert tuple(got.row) == (1, ls.TEMPLATES["MIT-line"], 3, "r") and got.license == "MIT-line"
    with pytest.raises(ValueError):
        ls.scan_licenses(df, spark.range(ls.MAX_TEMPLATES + 1).selectExpr("'n' AS name", "'t' AS text"))


def test_pieces_change_nothing(spark, monkeypatch):
    """A text of many pieces, notices across their edges; memory is that of a piece."""
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(500)}" for _ in range(30_000)]
    for name in sorted(ls.TEMPLATES):
        at = rnd.randrange(len(words))
        words[at:at] = ls.TEMPLATES[name].split()
    classes = ls.length_classes(sorted(ls.TEMPLATES.items()), 0.8, 0.999)
    import pyarrow as pa
    grams, _ = ls._grams(ls._words(pa.array([" ".join(words)])))
    whole = [c.scan(grams) for c in classes]
    monkeypatch.setattr(ls, "PIECE", 7)
    assert [c.scan(grams) for c in classes] == whole
    assert sum(map(len, whole)) >= len(ls.TEMPLATES)


def test_memory_of_a_long_text():
    import tracemalloc

    import numpy as np
    classes = ls.length_classes(sorted(ls.TEMPLATES.items()), 0.8, 0.999)
    grams = np.random.default_rng(1).integers(0, 2**63, 3_000_000).astype(np.uint64)
    tracemalloc.start()
    for c in classes:
        c.scan(grams)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6, peak


def test_short_templates_stand_word_for_word(spark):
    templates = spark.createDataFrame([("two", "MIT licensed"), ("one", "AGPL"), ("same", "mit Licensed"), ("none", "--")],
                                      "name string, text string")
    df = spark.createDataFrame([(1, "this is MIT-licensed, not agpl."), (2, "licensed mit"), (3, "AGPLv3"), (4, None)],
                               "doc_id long, text string")
    got = sorted((r.row.doc_id, r.license, r.containment, r.window_start, r.window_words)
                 for r in ls.scan_licenses(df, templates).collect())
    assert got == [(1, "one", 1.0, 5, 1), (1, "same", 1.0, 2, 2), (1, "two", 1.0, 2, 2)]
