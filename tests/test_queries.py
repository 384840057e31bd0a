"""Every query that SQL can state, against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = __import__("pitchlake.queries", fromlist=["QUERIES"])


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canon(rows):
    return sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(OWN.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = OWN.QUERIES[name](spark, SF)
    found = duck.execute(OWN.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert canon(map(tuple, got.select(names).collect())) == canon(found.fetchall())


@pytest.mark.parametrize("name", sorted(OWN.QUERIES.keys() - OWN.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert OWN.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
