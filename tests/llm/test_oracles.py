"""The queries that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from geoloom.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = oracle.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == sorted(repr(list(map(plain, r))) for r in found.fetchall())
