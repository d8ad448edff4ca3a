"""Every registered query of the chart engine against its DuckDB oracle, on whole tables."""

import datetime as dt
import decimal
import glob
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, dt.datetime):
        value = value.date()
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    wanted = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, wanted.fetchall())
