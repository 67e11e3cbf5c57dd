"""Every registered query runs on the smallest tables, and those with SQL give the same rows as DuckDB."""

import math

import duckdb
import pytest

from corpusloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return int(v) if isinstance(v, (bool, int)) or (isinstance(v, float) and v == int(v)) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 80


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in catalog.ORACLES:
        other = duck.execute(catalog.ORACLES[name])
        columns = [d[0] for d in other.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(other.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
