"""The operators' queries with an SQL twin give the same rows as DuckDB."""

import os

import duckdb
import pytest

from parley.llm import registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF_DIR):
        path = f"{SF_DIR}/{file}" + ("/*.parquet" if os.path.isdir(f"{SF_DIR}/{file}") else "")
        duck.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{path}')")
    ours = registry.QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = sorted(map(repr, cursor.fetchall()))
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == theirs
