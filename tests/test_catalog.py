"""Every registered query with SQL against DuckDB; the others run and keep their shape."""

from collections import Counter

import duckdb
import pytest

from vecskein import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    assert rows
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        want = [tuple(x) for x in want[sorted(want.columns)].itertuples(index=False)]
        assert Counter(rows) == Counter(want)
