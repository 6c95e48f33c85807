"""Every registered query with SQL, against DuckDB on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from millrace.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    rows = [tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    assert sorted(rows, key=repr) == sorted((tuple(cell(r[k]) for k in order) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "lang", "token_count"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
