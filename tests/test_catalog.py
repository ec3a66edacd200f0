"""Every registered query with an SQL twin against DuckDB, and the rest for their shape."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from wearpath.operators import rolling, sequence
from wearpath.plans import fixtures
from wearpath.plans.catalog import ORACLES, QUERIES

TABLES = "lineitem orders events".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(rows):
    return sorted([[0.0 if v == 0 else v for v in row] for row in rows], key=repr)


def check(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    result = database.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[k] for c, k in df.dtypes} == types
    columns = sorted(types)
    order = list(types)
    expected = plain([[row[order.index(c)] for c in columns] for row in result.fetchall()])
    found = plain([[row[c] for c in columns] for row in df.collect()])
    assert len(found) == len(expected) > 0
    assert found == expected


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, database, name):
    check(spark, sf_dir, database, name)


#: Queries whose computation per unit differs for long units.
PER_UNIT = [n for n in ORACLES if n.startswith(("p9", "p11", "p12", "w", "flagship", "a17_report", "l1", "job_prepare_test"))]


@pytest.mark.parametrize("name", sorted(PER_UNIT))
def test_query_equals_sql_when_units_are_long(spark, sf_dir, database, name, monkeypatch):
    """Every unit counts as long, so all rows take the way through slices."""
    find = sequence.find_long_units
    for module in (fixtures, sequence, rolling):
        monkeypatch.setattr(module, "find_long_units", lambda df, keys, time, *_: find(df, keys, time, 20))
    check(spark, sf_dir, database, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows
    values = [v for row in rows for v in row if isinstance(v, float)]
    assert all(math.isfinite(v) for v in values)


def test_entry(spark):
    assert entry_point.entry(spark).columns[:5] == ["id", "cycle", "rul", "label1", "label2"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
