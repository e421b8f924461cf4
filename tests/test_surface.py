"""Every executed statement against DuckDB on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from loomtrace import queries as q
from loomtrace.functions import surface


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(plain(r[i]) for i in order) for r in values], key=str)


REGISTERED = [n for n in q.QUERIES if n not in q.EXPLAINED and n != "lineage_flagship"]


@pytest.mark.parametrize("name", REGISTERED)
def test_query(spark, sf_dir, duck, name):
    df = q.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    r = duck.execute(q.ORACLES[name])
    assert got == rows([d[0] for d in r.description], r.fetchall())
