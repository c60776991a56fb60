"""The registered SQL of this folder in DuckDB against the queries, and the contract's columns."""

import duckdb
import pytest

from tarnlake.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    c.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in c.description]
    assert cols == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(c.fetchall())


def test_names():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
