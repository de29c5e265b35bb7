"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables; every other one runs."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(rows):
    def value(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, con, name):
    frame = registry.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    found = canonical(tuple(r) for r in frame.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert found == canonical(con.execute(f"SELECT {quoted} FROM ({registry.SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
