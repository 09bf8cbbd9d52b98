"""Every core query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from tagplace.jobs import oracles, queries

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(str([None if x is None or x != x else x for x in r]) for r in frame[names].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
