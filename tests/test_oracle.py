"""Every registered query against DuckDB on the same files."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.plans.oracle import ORACLE

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(tuple(str(row[c]) for c in columns) for row in df.collect())
    cursor = duck.execute(ORACLE[name])
    types = {c[0]: str(c[1]) for c in cursor.description}
    position = [list(types).index(c) for c in columns]
    theirs = sorted(tuple(str(row[i]) for i in position) for row in cursor.fetchall())
    assert sorted(types) == columns
    assert {c: TYPES.get(t, t.upper()) for c, t in df.dtypes} == types
    assert mine == theirs
    assert mine


def test_entry_is_the_whole_ledger(spark, sf_dir):
    assert entry(spark).count() == 7856


@pytest.mark.parametrize("name, order", [
    ("ledger_first_page", ["account_id", "date", "id"]),
    ("report_pivot_json", ["account_code", "company_id", "account_name"]),
])
def test_order_nulls_last(spark, sf_dir, name, order):
    rows = [tuple((r[c] is None, r[c]) for c in order) for r in QUERIES[name](spark, sf_dir).collect()]
    assert rows == sorted(rows, key=lambda row: [(null, "" if null else value) for null, value in row])
