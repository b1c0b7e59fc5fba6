"""Queries with SQL give the rows that SQL gives."""

import math

import duckdb
import pytest

from tailweave.llm import queries


def alike(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{d}/{table}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    df = queries.queries()[name](spark, d)
    assert sorted(df.columns) == sorted(names)
    got, want = (sorted(map(tuple, x), key=lambda r: [repr(v) for v in r]) for x in (df.select(*names).collect(), want.fetchall()))
    assert len(got) == len(want) and all(alike(a, b) for a, b in zip(got, want, strict=True))
