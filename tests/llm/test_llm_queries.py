"""Every opN_ query with an oracle against DuckDB, at the smallest scale."""

import duckdb
import pytest

from seclake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_oracle(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[key](spark, SF)
    want = con.sql(ORACLES[key])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = [tuple(r) for r in df.select(order).collect()]
    at = [want.columns.index(c) for c in order]
    assert sorted(map(str, got)) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
