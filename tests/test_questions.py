"""Every question with SQL gives the rows that DuckDB gives for it."""

import datetime
import decimal
import math

import duckdb
import pytest

from ravelin import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_question(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    wanted = duck.sql(sql)
    assert sorted(wanted.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    rows = duck.sql(f"SELECT {order} FROM ({sql})").fetchall()
    assert got == sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
