"""Every registered catalogue query against its SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tarnlake.plans import catalogue, catalogue_io

SF = "/root/testdata/sf0.01"
FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


QUERIES, SQL = catalogue.queries() | catalogue_io.queries(), catalogue.oracle_sql() | catalogue_io.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    duck.execute(SQL[name])
    names = [d[0] for d in duck.description]
    kinds = {d[0]: str(d[1]) for d in duck.description}
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in duck.fetchall())
    assert {c: FAMILY.get(k, k) for c, k in df.dtypes} == kinds
    assert len(got) == len(want)
    assert got == want
    assert got, "an empty result shows nothing"
