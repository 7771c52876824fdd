"""Driver contract and a differential check of every key at sf0.001."""

import datetime as dt
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from funnelkit.plans.registry import QUERIES
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem".split()


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["year", "week_num"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())
    assert len(QUERIES) == 36


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _bag(cols, rs):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in idx) for r in rs), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet("
                    f"'{os.path.join(SF_SMALL, t)}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = queries()[key](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert _bag(df.columns, got) == _bag(cols, want)
