"""Every registered query runs on the smallest tables and equals its DuckDB statement there."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from turnloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (float, Decimal)) else str(v)

    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        got = duck.execute(ORACLE[name])
        names = [c[0] for c in got.description]
        assert sorted(df.columns) == sorted(names)
        assert plain(rows, df.columns) == plain(got.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["category", "n", "pct", "avg_before", "avg_user_chars"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
