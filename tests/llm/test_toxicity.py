import math
import random
import zlib

import numpy as np
import pyarrow as pa

from funnelkit.llm import toxicity as tx
from funnelkit.llm import words as w


def corpus(n, seed=1):
    rnd = random.Random(seed)
    syllables = ["an", "ti", "on", "re", "ha", "st", "ou", "le"]
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.2
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5)))
                 for _ in range(rnd.randrange(20, 200))]
        if bad:
            for _ in range(max(3, len(words) // 40)):
                words[rnd.randrange(len(words))] = rnd.choice(["Snark!", "blarg", "zzgrum" + rnd.choice(syllables)])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2))


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500)
    out = {r.doc_id: r for r in tx.score_documents(*frames(spark, docs, labels)).select(
        "row.doc_id", "held_out", "score", "predicted").collect()}
    truth = {d: t for d, _, t in labels}
    held = [d for d in out if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(out[d].held_out == (d in set(held)) for d in out)
    assert np.mean([out[d].predicted == truth[d] for d in held]) > 0.95
    toxic = [out[d].score for d in held if truth[d]]
    clean = [out[d].score for d in held if not truth[d]]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.97


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(300)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    one = tx.score_documents(*frames(spark, docs, labels)).select("row.doc_id", "score")
    two = tx.score_documents(*frames(spark, docs, turned)).select("row.doc_id", "score")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_odd_rows(spark):
    docs, labels = corpus(200)
    odd = [(None, "no id"), (5000, None), (5001, ""), (5002, " ... !"), docs[0], docs[0], (5003, "word " * 100_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs + odd],
                               "doc_id long, text string, held_out string, score int")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 0, None), (4, 0, 7), (5000, 1, 1), (5, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    out = tx.score_documents(df, marks)
    got = out.collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = {r.score for r in got if r.row.doc_id in (5000, 5001, 5002)}
    assert len(empty) == 1
    kept = tx.drop_toxic(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_without_labels(spark):
    docs, labels = corpus(30)
    df, marks = frames(spark, docs, labels)
    for few in (marks.limit(0), marks.where("toxic = 0")):
        scores = {r.score for r in tx.score_documents(df, few).collect()}
        assert len(scores) == 1 and max(scores) < 0.5
    assert tx.score_documents(df.limit(0), marks).collect() == []


def test_ratios_equal_a_plain_model(spark):
    docs, labels = corpus(120, seed=3)
    df, marks = frames(spark, docs, labels)
    rows = [(t, lab) for (_, t), (_, _, lab) in zip(docs, labels, strict=True)]
    labelled = spark.createDataFrame(rows, "text string, grp int").repartition(3)
    _, model = tx.fit_models(labelled)
    tokens, clean = [{}, {}], lambda t: t.lower().replace("!", " ").split()
    for t, lab in rows:
        for x in clean(t):
            tokens[lab][x] = tokens[lab].get(x, 0) + 1
    types = [{k: [{}, {}] for k in (7, 5)}][0]
    for c in (0, 1):
        for x in tokens[c]:
            for k in (7, 5):
                types[k][c][x[:k]] = types[k][c].get(x[:k], 0) + 1
    both = {k: {g: sum(types[k][c].get(g, 0) for c in (0, 1)) for g in {**types[k][0], **types[k][1]}} for k in (7, 5)}

    def p(x, c):
        v, n, d = len(tokens[c]), sum(tokens[c].values()), tx.DISCOUNT
        s7, s5 = both[7].get(x[:7], 0), both[5].get(x[:5], 0)
        q = (s5 + 0.5) / (sum(both[5].values()) + 5e3)
        q = max(types[5][c].get(x[:5], 0) - d, 0) / v + d * len(types[5][c]) / v * q
        q *= (s7 + 0.5) / (s5 + 1)
        q = max(types[7][c].get(x[:7], 0) - d, 0) / v + d * len(types[7][c]) / v * q
        own = tokens[c].get(x, 0)
        return max(own - d, 0) / n + d * v / n * q / (s7 + 1)

    probe = ["snark", "blarg", "zzgrumti", "zzgrumxx", "an", "tionre", "never", "onhastou"]
    for word in probe:
        buf, off = w.string_buffer(pa.array([word]))
        assert math.isclose(model.ratios(tx.word_keys(buf, off)[0])[0], math.log(p(word, 1) / p(word, 0)), rel_tol=1e-4)


def test_words_and_prefixes_are_not_merged(spark):
    """More prefixes than any fixed table held, and words seen once, all keep their own counts."""
    rnd = random.Random(5)
    clean = ["%07x" % rnd.randrange(16**7) for _ in range(400_000)]
    rows = [(" ".join(clean[i:i + 1000]), 0) for i in range(0, len(clean), 1000)]
    rows += [("qqrarely once " + "plain " * 50, 1), ("plain " * 50, 0)]
    _, model = tx.fit_models(spark.createDataFrame(rows, "text string, grp int").repartition(4))
    buf, off = w.string_buffer(pa.array(["qqrarely", "qqrarelx", "zzzzzzz"]))
    once, like, never = model.ratios(tx.word_keys(buf, off)[0])
    words = {x for t, _ in rows for x in t.split()}
    assert len(model.keys[0]) == len(words) and len(model.keys[1]) == len({x[:7] for x in words})
    assert once > like > never


def test_shuffle_join_equals_broadcast(spark, monkeypatch):
    docs, labels = corpus(250, seed=4)
    docs += [(None, "no id"), (7000, None), (7001, " ... "), docs[0], (7002, "snark " * 50_000)]
    df, marks = frames(spark, docs, labels)

    def scores():
        out = tx.score_documents(df, marks).select("row.doc_id", "row.text", "held_out", "score", "predicted")
        return sorted(map(str, out.collect()))

    one = scores()
    monkeypatch.setattr(tx, "MODEL_ROWS", 0)
    monkeypatch.setattr(tx, "BLOCK_BITS", 4)
    assert scores() == one and len(one) == len(docs)
