"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from seqforge.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, str) else round(float(v), 9)

    return sorted(repr(tuple(map(cell, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
