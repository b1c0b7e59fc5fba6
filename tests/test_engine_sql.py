"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tailweave import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def close(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda r: [plain(v) for v in r]
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want, strict=True))
