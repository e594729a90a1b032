"""Every query against the same question in another engine, on the smallest shared tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lodestar.plans.library import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, got) == _rows(list(rel.columns), rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
