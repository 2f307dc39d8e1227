"""Registered queries against their SQL on the smallest test data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tidemark.workload import oracle
from tidemark.workload import queries as registered

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(registered.queries()) == set(oracle.oracle_sql())
    assert set(registered.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_sql(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    got = check.canonical(frame.columns, frame.collect())
    assert got == check.canonical(columns, result.fetchall())
    assert got or name == "f9_only_issues"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


# Totals known from elsewhere for the narrow form of the derived tables (8 partitions).
KNOWN = {"0.001": (1020, 15995, 5366, 51697, 748, 26099, 750, 3097)}


@pytest.mark.parametrize("sf", KNOWN)
def test_known_totals(spark, sf):
    from pyspark.sql import functions as F

    from tidemark import Options
    from tidemark.operators.clean import prepare
    from tidemark.operators.lag import lag_stats
    from tidemark.operators.rates import group_rates
    from tidemark.workload.views import stored_tables

    tables = stored_tables(spark, f"/root/testdata/sf{sf}", "user_id % 8")
    prepared = prepare(tables, Options(show_empty=True))
    found = []
    for df, column in [
        (tables.topic_offsets.filter("error is null"), "end_offset"),
        (tables.group_offsets.filter("error is null"), "committed_offset"),
        (lag_stats(prepared), "lag_sum"),
        (group_rates(prepared, False), "events_consumed"),
    ]:
        found += df.agg(F.count("*"), F.sum(column)).first()
    assert tuple(found) == KNOWN[sf]
