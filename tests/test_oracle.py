"""Each registered query with SQL against DuckDB on the smallest dataset."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame, names):
    null = lambda v: v is None or v is pd.NA or v is pd.NaT or v != v
    plain = lambda v: "null" if null(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert rows(got, names) == rows(want, names)
