"""Queries by key, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert key not in QUERIES, key
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return f

    return add
