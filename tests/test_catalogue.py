"""Every registered query against its SQL, on the smallest tables, where these are present."""

import os

import duckdb
import pytest

from recframe import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(rows):
    return sorted(repr([x.item() if hasattr(x, "item") else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sql, name):
    query, text = catalogue.QUERIES[name]
    df = query(spark, DATA)
    columns = sorted(df.columns)
    expected = sql.execute(text)
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    rows = [tuple(dict(zip(names, r))[c] for c in columns) for r in expected.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(rows)


def test_entry_works_with_and_without_the_training_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
