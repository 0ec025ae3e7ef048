"""The queries against their SQL, over whole tables."""

import duckdb
import pytest

from millrace.llm import oracles, queries

TABLES = ("documents", "embeddings", "pages", "conversations")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.sql(oracles.oracle_sql()[name])
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(result.columns, result.fetchall())
