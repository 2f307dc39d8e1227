"""The physical plans that the design relies on."""

import os
import re
from datetime import date

import pytest

from tidemark import Options
from tidemark.operators import clean
from tidemark.operators.clean import Prepared, prepare
from tidemark.operators.lag import lag_stats, partition_lag
from tidemark.operators.rates import arrival_rates, group_rates, partition_rates
from tidemark.plans.reports import partition_detail
from tidemark.workload import queries as registered
from tidemark.sources.layout import load_bucketed
from tidemark.workload.views import bucketed_name, bucketed_tables, stored_tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare(stored_tables(spark, FOLDER), Options(include="^g-"))


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


@pytest.mark.parametrize("name", sorted(n for n in registered.queries() if not n.startswith("x")))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(registered.queries()[name](spark, FOLDER))
    for node in ("NestedLoop", "Cartesian", "Python", "ArrowEval"):
        assert node not in text


def test_scan_reads_what_it_needs(prepared):
    text = plan(partition_lag(prepared))
    assert "ReadSchema: struct<topic:string,partition:int,end_offset:bigint,error:string>" in text
    assert "captured_at" not in text
    for scan in text.split("FileScan")[1:]:
        if "end_offset:bigint" in scan or "committed_offset:bigint" in scan:
            assert "IsNull(error)" in scan.split("PushedFilters: ")[1].split("]")[0]


def test_snapshot_filter_prunes_files(spark):
    text = plan(partition_lag(prepare(stored_tables(spark, FOLDER).between(3, 4))))
    assert text.count("(snapshot_id#") and "PartitionFilters: [isnotnull(snapshot_id" in text
    assert re.search(r"PartitionFilters: \[[^\]]*>= 3\)[^\]]*<= 4\)", text)


def keys(exchange):
    return [k.split("#")[0].strip() for k in exchange.split(",") if "#" in k]


def test_pairs_meet_in_one_shuffle_of_the_rows(prepared):
    """Blocks, then one row per snapshot, group and topic; no self-join."""
    found = [keys(e) for e in exchanges(group_rates(prepared, with_lag=False))]
    assert ["block", "chunk", "group_id", "topic"] in found
    assert ["block", "group_id", "topic"] in found
    assert sum("block" in k for k in found) == 2
    found = [keys(e) for e in exchanges(partition_rates(prepared))]
    assert sum("block" in k for k in found) == 1


def test_detail_ranks_without_another_shuffle(prepared):
    found = [keys(e) for e in exchanges(partition_detail(prepared))]
    assert not [k for k in found if set(k) == {"snapshot_id", "group_id", "topic"}]


def test_aggregates_combine_before_the_shuffle(prepared):
    for df in (lag_stats(prepared, median=False), arrival_rates(prepared)):
        assert "partial_sum" in plan(df)


def test_bucketed_lag_has_no_shuffle(spark):
    tables = bucketed_tables(spark, FOLDER)
    text = plan(partition_lag(prepare(tables)))
    assert "Exchange hashpartitioning" not in text and text.count("Bucketed: true") == 2
    some = load_bucketed(
        spark, bucketed_name(spark, FOLDER), (date(2024, 1, 4), date(2024, 1, 5)), snapshots=tables.snapshots
    )
    few = partition_lag(prepare(some))
    assert re.search(r"PartitionFilters: \[[^\]]*day#", plan(few))
    want = partition_lag(prepare(stored_tables(spark, FOLDER).between(3, 4), Options(show_empty=True)))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, want.collect())) != []


def test_tasks_of_the_pairs_follow_the_rows(spark, prepared, monkeypatch):
    """Spark would merge partitions by their compressed bytes, whatever a task then sorts. The partition
    leads the sort, as polls and topics are the same in very many rows."""
    rows = prepared.given.count()
    monkeypatch.setattr(clean, "ROWS_A_TASK", rows // 9)
    assert prepared.tasks() in (9, 10)
    text = plan(partition_rates(prepared))
    assert re.search(rf"hashpartitioning\(block[^)]*, {prepared.tasks()}\), REPARTITION_BY_NUM", text)
    assert re.search(r"Sort \[partition#\d+ ASC[^\]]*block", text)


def test_details_are_numbered_in_one_pass(spark):
    """Up to TOPIC_ROWS partitions the rows are shuffled once for all orders, and nothing is sampled."""
    for name in ("p4_detail_sorted", "p4_detail_sort_keys"):
        text = plan(registered.queries()[name](spark, FOLDER))
        assert text.count("hashpartitioning(snapshot_id") - text.count("hashpartitioning(snapshot_id#0") == 1
        assert "min_by" not in text and "Subquery" not in text


@pytest.mark.parametrize("limits", [(4096, 1 << 20), (4, 1 << 20), (4, 4)])
def test_detail_is_the_same_by_any_width(spark, monkeypatch, limits):
    """Ranges of a topic by its chunk, by one shuffle of whole topics, or by a join of the extremes."""
    tables = stored_tables(spark, FOLDER)
    ready = prepare(tables, Options(include="^g-s"))
    want = sorted(map(tuple, partition_detail(ready, tables.topic_partitions).collect()))
    top = ready.end_offsets.agg({"partition": "max"}).first()[0]
    monkeypatch.setattr(Prepared, "is_narrow", lambda self, at_most=4096: at_most == limits[0] > top)
    if limits[1] > 4:
        monkeypatch.setattr(Prepared, "is_narrow", lambda self, at_most=4096: (limits[0] if at_most == 4096 else at_most) > top)
    found = partition_detail(ready, tables.topic_partitions)
    assert sorted(map(tuple, found.collect())) == want != []
