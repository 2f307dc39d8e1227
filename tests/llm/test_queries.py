"""The registered queries against their SQL, and the pipeline stage by stage."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from tidemark.llm import oracle
from tidemark.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_registered():
    names = [n.split("_")[0] for n in queries()]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]
    assert {*queries(), "pipeline"} <= set(entry.queries())
    assert set(oracle.oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    rows = frame.collect()
    sql = oracle.oracle_sql().get(name)
    if sql:
        result = db.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(frame.columns) == sorted(columns)
        assert check.canonical(frame.columns, rows) == check.canonical(columns, result.fetchall())
    elif name not in ("op9_spaced_seeds",):
        of, key = ("conversations", "conv_id") if name.startswith("op13") else ("documents", "doc_id")
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{of}.parquet").select(key).distinct().count()


def test_shard_law(spark):
    rows = entry.queries()["op2_virtual_slots"](spark, FOLDER).collect()
    places = Counter((r.shard, r.slot) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert set(places) == {(s, i) for s, n in sizes.items() for i in range(n)}
    assert all(0 <= r.shard < 24 for r in rows) and len({r.virtual_slot for r in rows}) > 24


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] >= kept[3] > 0 and kept[4] > kept[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == kept[4] and last.columns == [*columns, "shard", "virtual_slot"]
    whole = corpus_pipeline.run(spark, FOLDER)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "shard", "virtual_slot").collect()))
    assert key(whole) == key(last)
