"""Every registered query against its SQL twin, over whole tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from burnish import queries
from burnish.session import scratch, shared_folder

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    yield con
    con.close()


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def plain(value):
    if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()[:10]
    return value


def sorted_rows(rows, columns, want):
    at = [columns.index(c) for c in want]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def left_over(spark):
    folder = f"{shared_folder(spark)}/burnish"
    return os.listdir(folder) if os.path.isdir(folder) else []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    before = left_over(spark)
    with scratch(spark):
        check(QUERIES[name](spark, sf_dir), tables, name)
    assert left_over(spark) == before  # a job leaves nothing behind


def check(found, tables, name):
    rel = tables.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(found.columns) == sorted(names)
    want = sorted(names)
    kinds = {d[0]: str(d[1]) for d in rel.description}
    assert {c: KINDS[k] for c, k in found.dtypes} == kinds
    assert sorted_rows(found.collect(), found.columns, want) == sorted_rows(rel.fetchall(), names, want)


def test_entry(spark):
    row = driver.entry(spark).first()
    assert row.column_score == 0.99 and row.reward > 0.9
