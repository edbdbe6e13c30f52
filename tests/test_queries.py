"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gleanery import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(values, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in at) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    told = duck.sql(catalog.oracle_sql()[name])
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(told.fetchall(), told.columns)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).columns == ["doc_id", "score"]
