"""Whole texts reach a Python task once, whatever the type of their column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from funnelkit.llm import words as w
from funnelkit.llm.shared import with_row


def read_texts():
    def run(batches):   # local, as Python workers cannot import the tests
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.as_py() for t in w.texts_of(batch)], pa.string())], names=["seen"])
    return run


def test_with_row_holds_the_text_once(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (3, "", 9)],
                                 "doc_id long, text string, row int")
    once = with_row(docs, F.lit(1).alias("more"))
    assert once.columns == ["row", "more"]
    assert once.first().row.row == 7
    seen = [r.seen for r in once.mapInArrow(read_texts(), "seen string").collect()]
    assert sorted(seen, key=str) == ["", None, "a b"]


def test_with_row_casts_other_texts(spark):
    docs = spark.createDataFrame([(1, 12), (2, None)], "doc_id long, text int")
    cast = with_row(docs)
    assert cast.columns == ["row", "text"]
    seen = {r.seen for r in cast.mapInArrow(read_texts(), "seen string").collect()}
    assert seen == {"12", None}
