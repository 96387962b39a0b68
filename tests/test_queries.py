"""Every registered query against its SQL, at the smallest scale."""

import decimal
import os

import duckdb
import pytest

from seclake.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v == int(v) else float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, SF)
    got = df.collect()
    if key in ORACLES:
        want = duck.sql(ORACLES[key])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
