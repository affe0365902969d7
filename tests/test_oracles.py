"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from workload.oracles import ORACLES
from workload.registry import QUERIES

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return db


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(names), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, db, name):
    found = QUERIES[name](spark, sf)
    want = db.sql(ORACLES[name])
    assert plain(found.collect(), found.columns) == plain(want.fetchall(), want.columns)
