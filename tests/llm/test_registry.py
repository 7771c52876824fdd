"""Registered queries on the smallest tables, and the pipeline against its operators' brute force."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from funnelkit.llm.registry import QUERIES, SQL
from funnelkit.llm.toxicity import score_documents
from tests.conftest import SF_SMALL
from tests.llm.test_ngram_join import brute as linked
from tests.llm.test_substring import brute as cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql()) and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("key", sorted(SQL))
def test_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    cur = con.execute(SQL[key])
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    df = QUERIES[key](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "substring_dedup", "source_mix", "bpe_automaton"]
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, SF_SMALL).cache()
    bad = {r.doc_id for r in score_documents(docs, labels).where("predicted = 1").select(
        "row.doc_id").collect()}
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    assert clean.columns == docs.columns
    assert {r.doc_id: tuple(r) for r in clean.collect()} == {d: r for d, r in rows.items() if d not in bad}

    one = steps["ngram_jaccard_join"](spark, clean, SF_SMALL).cache()
    source = [(r.doc_id, r.text) for r in clean.collect()]
    kept = {d for d, n, low in linked(source) if not n or d == low}
    assert {r.doc_id: tuple(r) for r in one.collect()} == {d: rows[d] for d in kept}

    thin = steps["substring_dedup"](spark, one, SF_SMALL).cache()
    assert thin.columns == docs.columns
    removed = {d: n for d, _, n, _ in cut([(r.doc_id, r.text) for r in one.collect()])}
    for r in thin.collect():
        words, old = WORD.findall(r.text), WORD.findall(rows[r.doc_id][1])
        assert len(words) == len(old) - removed[r.doc_id]
        assert removed[r.doc_id] or tuple(r) == rows[r.doc_id]

    mixed = steps["source_mix"](spark, thin, SF_SMALL).cache()
    texts = {r.doc_id: r.text for r in thin.collect()}
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    out = steps["bpe_automaton"](spark, mixed, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.count() == mixed.count()
    want = sorted(tuple(r) for r in out.collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == want


def _folder(spark, tmp_path, docs, schema, labels):
    folder = str(tmp_path)
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_whole_pipeline_against_plain_steps(spark, tmp_path):
    """One source and no toxic label: what stays, and its tokens, follow from the plain versions alone.

    NULL and empty texts, near copies, shared passages, columns with clashing names.
    """
    import hashlib
    import random

    import numpy as np
    tokenizers = pytest.importorskip("tokenizers")
    from funnelkit.llm.bpe import tokenizer_path
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 120))) for _ in range(40)]
    texts += [t + " tail" for t in texts[:8] if len(t.split()) > 40] + texts[8:12]
    shared = " ".join(rnd.choice(vocab) for _ in range(30))
    texts += [f"{texts[20 + i]}\n{shared}  {texts[30 + i]} naïve" for i in range(5)] + [None, "", " \n ", "one"]
    docs = [(i, t, "en", "a", len(t or ""), "row", i, 0.5) for i, t in enumerate(texts)]
    folder = _folder(spark, tmp_path, docs, "doc_id long, text string, lang string, source string, n_chars long, "
                     "row string, size long, u double", [(i, 1, 0) for i in range(0, len(texts), 2)])
    out = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    kept = [(d, texts[d]) for d, n, low in linked([(i, t) for i, t in enumerate(texts)]) if not n or d == low]
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    seen, want = {}, []
    for d, t in sorted(kept):
        for i in range(len(WORD.findall(t or "")) - 19):
            seen.setdefault(tuple(WORD.findall(t)[i:i + 20]), (d, i))
    for d, t in kept:
        ws, gone = WORD.findall(t or ""), set()
        for i in range(len(ws) - 19):
            if seen[tuple(ws[i:i + 20])] < (d, i):
                gone.update(range(i, i + 20))
        t = " ".join(x for i, x in enumerate(ws) if i not in gone) if gone else t
        if WORD.findall(t or ""):      # empty texts are never drawn; the rest is taken once
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(
                library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert len(want) < len(texts) - 8 and out == sorted(want)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = _folder(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long", [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.run(spark, folder).collect() == []
