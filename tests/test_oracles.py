"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from parley import registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        path = f"{SF_DIR}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF_DIR}/{name}") else "")
        connection.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(registry.ORACLES[name])
    theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == theirs
