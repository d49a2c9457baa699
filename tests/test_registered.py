"""Every registered query against its SQL on the smallest data set."""

import os

import duckdb
import pytest

from __spark_entry__ import _ALL, entry, oracle_sql, queries


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(_ALL))
def test_query(spark, small, duck, name):
    df = queries()[name](spark, small)
    rows, columns = df.collect(), df.columns
    text = oracle_sql().get(name)
    if text is None:
        assert rows
        return
    out = duck.execute(text)
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in out.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["ask_id", "id", "fact_id", "version", "valid_until"] and df.count() > 0
