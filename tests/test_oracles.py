"""Each catalogue query against its SQL in DuckDB, over the driver's tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

import gneiss.plans.catalogue
import gneiss.plans.contracts
import gneiss.plans.elements
import gneiss.plans.files
import gneiss.plans.imaging
import gneiss.plans.ledger
import gneiss.plans.series
import gneiss.plans.validators
import gneiss.plans.streams
import gneiss.plans.units  # noqa: F401
from gneiss.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
