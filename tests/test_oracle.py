"""Every query that has a DuckDB twin gives the same rows as it on the smallest tables."""

import os

import duckdb
import pytest

from tallyforge import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    found = duck.sql(plans.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=key)
    want = sorted((plain(r) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert got == want
