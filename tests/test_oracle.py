"""Every engine query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from retroledger import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v) if isinstance(v, str | bool) or not hasattr(v, "__float__") else round(float(v), 6)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", queries.queries())
def test_query(name, spark, db):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = queries.oracle_sql()[name]
    theirs = db.sql(sql)
    assert sorted(theirs.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert ours == sorted((tuple(map(plain, r)) for r in db.sql(f"SELECT {quoted} FROM ({sql})").fetchall()), key=repr)
