"""The queries that SQL can express, against DuckDB over whole tables."""

from collections import Counter

import duckdb
import pytest

from vecskein.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = Counter(tuple(r[c] for c in names) for r in got.collect())
    assert rows and rows == Counter(want.fetchall())
