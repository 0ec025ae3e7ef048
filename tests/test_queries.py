"""Every query that has SQL gives the SQL's rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from millrace.plans import queries as own  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query(spark, duck, sf, name):
    df = own.queries()[name](spark, sf)
    result = duck.sql(own.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    expected = rows(result.columns, result.fetchall())
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(found) == len(expected)
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert own.queries()[name](spark, sf).count() > 0
