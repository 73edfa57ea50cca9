"""Every core query against its SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from lorewell.plans import catalogue


def shown(x):
    return "NULL" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        names = rel.columns
        assert sorted(names) == sorted(df.columns)
        assert got == sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_without_llm(monkeypatch):
    monkeypatch.setattr(entry_module, "_llm", lambda: None)
    assert "bm25_topk" in entry_module.queries() and "p6_ids" not in entry_module.queries()
