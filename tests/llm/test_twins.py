"""Every query of this package that has a DuckDB twin gives the same rows as it on the smallest tables."""

import os

import duckdb
import pytest

from tallyforge.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    found = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    plain = lambda r: tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=key)
    want = sorted((plain(r) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert got == want
