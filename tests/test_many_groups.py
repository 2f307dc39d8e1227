"""Very many groups, few of them with offsets: the table of groups is a small file and a large hash table."""

import re
from datetime import timedelta

import pytest
from conftest import EPOCH, rows
from pyspark.sql import functions as F

from tidemark import LagTables, Options
from tidemark.operators import clean
from tidemark.operators.clean import prepare
from tidemark.operators.lag import lag_stats
from tidemark.operators.rates import rates
from tidemark.plans import reports
from tidemark.schemas import SCHEMAS
from tidemark.session import broadcast_by_count, small_tasks
from tidemark.streaming.closed import ClosedPolls

MANY = 120_000
# Committed offsets of partition 0 at the polls 1 and 2; ends are 100 and 200.
OFFSETS = {"a": (10, 60), "b": (0, 0), "empty": (5, 5), "unknown": (1, 2)}
KEYS = ("snapshot_id", "group_id", "topic")


@pytest.fixture(scope="module")
def tables(spark, make, tmp_path_factory):
    """Groups c-0, c-1, ... at two polls, as files, besides those with offsets and one listed twice."""
    folder = str(tmp_path_factory.mktemp("groups"))
    named = F.format_string("c-%d", F.expr("id div 2"))
    grown = spark.range(MANY * 2).select(F.expr("id % 2 + 1").alias("snapshot_id"), named.alias("group_id"))
    own = [(s, g) for s in (1, 2) for g in ("a", "a", "b", "empty", None)]
    listed = grown.unionByName(spark.createDataFrame(own, "snapshot_id bigint, group_id string"))
    listed.select(
        *("snapshot_id", "group_id"),
        F.when(F.col("group_id") == "empty", "Empty").otherwise("Stable").alias("raw_state"),
        F.lit(1).alias("member_count"),
        F.lit(False).alias("describe_failed"),
        F.lit(False).alias("is_simple"),
    ).coalesce(1).write.mode("overwrite").parquet(folder)
    committed = {s: {g: {"t": {0: o[s - 1]}} for g, o in OFFSETS.items()} for s in (1, 2)}
    made = make.tables(committed, {1: {"t": {0: 100}}, 2: {"t": {0: 200}}})
    groups = spark.read.schema(SCHEMAS["groups"]).parquet(folder)
    # A small file by any estimate, and more rows than are broadcast.
    assert groups._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 20 << 20
    assert groups.count() > clean.BROADCAST_GROUPS
    return LagTables(made.group_offsets, made.topic_offsets, groups=groups)


def sent(df):
    """What the plan broadcasts, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [re.match(r"[ :+\-]*", line).end() for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            inner = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:inner])


def only_small(df):
    return not any("raw_state" in part for part in sent(df))


@pytest.fixture(autouse=True)
def usual_estimates(spark):
    """The session estimates by the bytes of files, as one does that names no factor."""
    name = "spark.sql.sources.fileCompressionFactor"
    usual = spark.conf.get(name)
    spark.conf.set(name, "1")
    yield
    spark.conf.set(name, usual)


def test_lag_statistics_do_not_broadcast_many_groups(tables):  # h7_h8_bands
    stats = lag_stats(prepare(tables), median=False)
    assert only_small(stats)
    assert rows(stats, *KEYS, "lag_sum") == [(1, "a", "t", 90), (1, "b", "t", 100), (2, "a", "t", 140), (2, "b", "t", 200)]
    shown = lag_stats(prepare(tables, Options(show_empty=True)), median=False)
    assert {r.group_id for r in shown.collect()} == {"a", "b", "empty"}


def test_every_group_with_offsets(spark, tables, monkeypatch):
    """Those with offsets are too many to broadcast as well."""
    monkeypatch.setattr(clean, "BROADCAST_GROUPS", 1)
    stats = lag_stats(prepare(tables), median=False)
    assert not list(sent(prepare(tables).committed))
    assert rows(stats, *KEYS, "lag_sum") == [(1, "a", "t", 90), (1, "b", "t", 100), (2, "a", "t", 140), (2, "b", "t", 200)]


def test_the_states_of_many_groups_are_not_broadcast(tables):
    table = reports.lag_table(prepare(tables))
    assert only_small(table)
    assert rows(table, *KEYS, "state") == [(s, g, "t", "STABLE") for s in (1, 2) for g in ("a", "b")]


def test_count_decides_what_is_broadcast(spark):
    small = spark.range(3)
    joined = [spark.range(9).join(broadcast_by_count(small, n), "id") for n in (3, 2)]
    assert [bool(list(sent(df))) for df in joined] == [True, False]


def test_a_session_takes_the_factor_unless_it_has_one(spark):
    name = "spark.sql.sources.fileCompressionFactor"
    small_tasks(spark)
    assert spark.conf.get(name) == "1"
    other = spark.newSession()
    other.conf.unset(name)
    small_tasks(other)
    assert float(other.conf.get(name)) > 1


def test_the_followed_row_of_many_groups(tables):  # a13_follow
    followed = reports.follow(reports.report(prepare(tables)))
    assert only_small(followed)
    assert rows(followed, *KEYS, "lag") == [(2, "b", "t", 200)]


def test_simple_etas_of_many_groups(tables):  # k6_eta_simple
    simple = rates(prepare(tables, Options(eta_method="simple")))
    assert only_small(simple)
    assert rows(simple, *KEYS, "remaining_sec") == [(2, "a", "t", 28), (2, "b", "t", -1)]


def test_a_micro_batch_with_many_groups(spark, tables, tmp_path):  # x2_streaming_rates
    seen = []

    def analyse(t, options):
        seen.append(rates(prepare(t, options)))
        return seen[-1]

    time = {s: EPOCH + timedelta(seconds=10 * s) for s in (1, 2)}
    kept = [(s, time[s], "group", g, "t", 0, o[s - 1], None) for s in time for g, o in OFFSETS.items()]
    ends = [(s, time[s], "topic", None, "t", 0, 100 * s, None) for s in time]
    columns = "snapshot_id bigint, captured_at timestamp, kind string, group_id string, topic string, partition int, offset bigint, error string"
    sink = ClosedPolls(analyse, str(tmp_path), pairs=True, groups=tables.groups)
    sink(spark.createDataFrame(kept + ends, columns), 0)
    assert len(seen) == 1 and only_small(seen[0])
    assert rows(sink.results(spark), *KEYS, "events_consumed", "lag_sum") == [(2, "a", "t", 50, 140), (2, "b", "t", 0, 200)]
