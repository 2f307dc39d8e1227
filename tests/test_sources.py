import random
from datetime import timedelta

import pytest
from conftest import EPOCH, rows
from pyspark.sql import functions as F

from tidemark import LagTables
from tidemark.schemas import SCHEMAS
from tidemark.sources import logs
from tidemark.sources.logs import committed_offsets_from_log, end_offsets_from_log
from tidemark.sources.snapshots import snapshot_index
from tidemark.sources.tables import read_table


def index(make, seconds):
    data = [(s, EPOCH + timedelta(seconds=t)) for s, t in seconds.items()]
    polls = make.spark.createDataFrame(data, SCHEMAS["snapshots"])
    return snapshot_index(LagTables(group_offsets=None, topic_offsets=None, snapshots=polls))


@pytest.mark.parametrize("stretches", [1 << 16, 2])
@pytest.mark.parametrize("polls", [{5: 10, 6: 20, 9: 30}, {1: 0, 2: 1, 3: 500, 4: 501, 8: 502.5}, {4: 7}])
def test_logs_as_of_irregular_polls(make, monkeypatch, polls, stretches):
    monkeypatch.setattr(logs, "STRETCHES", stretches)
    rng = random.Random(1)
    log, commits = [], []
    for p in range(3):
        times = sorted(rng.choice([0, 1, 10, 20.5, 499, 501, 502.5, 600, -50]) + rng.random() * rng.choice([0, 9]) for _ in range(30))
        log += [dict(topic="t", partition=p, offset=i, timestamp=EPOCH + timedelta(seconds=t)) for i, t in enumerate(times)]
        commits += [dict(group_id="g", topic="t", partition=p, offset=rng.randrange(99), commit_ts=EPOCH + timedelta(seconds=t)) for t in times]
    polls_df = index(make, polls)
    ends = end_offsets_from_log(make.frame("topic_log", log), polls_df)
    assert ends.schema.names == SCHEMAS["topic_offsets"].names
    want, want_committed = [], []
    for s, at in polls.items():
        limit = EPOCH + timedelta(seconds=at)
        for p in range(3):
            seen = [r["offset"] for r in log if r["partition"] == p and r["timestamp"] <= limit]
            if seen:
                want.append((s, p, max(seen) + 1))
            made = [(r["commit_ts"], r["offset"]) for r in commits if r["partition"] == p and r["commit_ts"] <= limit]
            if made:
                want_committed.append((s, p, max(made)[1]))
    assert rows(ends, "snapshot_id", "partition", "end_offset") == sorted(want, key=repr)
    committed = committed_offsets_from_log(make.frame("commit_log", commits), polls_df)
    assert committed.schema.names == [c for c in SCHEMAS["group_offsets"].names]
    assert rows(committed, "snapshot_id", "partition", "committed_offset") == sorted(want_committed, key=repr)


@pytest.mark.parametrize("stretches", [1 << 16, 7])
def test_a_record_meets_one_stretch_however_uneven_the_polls(make, monkeypatch, stretches):
    """A poll a year before the others: no more joined rows than records."""
    monkeypatch.setattr(logs, "STRETCHES", stretches)
    polls = logs._Polls(index(make, {1: -31536000} | {i: i for i in range(2, 102)}))
    assert len(polls.bounds) <= stretches
    log = make.spark.range(5000).selectExpr(f"timestamp'{EPOCH}' + make_interval(0,0,0,0,0,0,id / 50) as timestamp")
    found = logs._assign(log, log["timestamp"], polls)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan
    counts = {r.snapshot_seq: r["count"] for r in found.groupBy("snapshot_seq").count().collect()}
    # Poll i has number i - 1 and takes the records after second i - 1 up to second i; the
    # first one after the early poll takes those up to second 2.
    assert counts == {1: 101, 99: 49} | {i: 50 for i in range(2, 99)}


def test_polls_at_one_time_and_without_a_time(make):
    log = [dict(topic="t", partition=0, offset=o, timestamp=EPOCH + timedelta(seconds=o)) for o in (4, 15)]
    ends = end_offsets_from_log(make.frame("topic_log", log), index(make, {1: 10, 2: 10, 3: 20}))
    assert rows(ends, "snapshot_id", "end_offset") == [(1, 5), (2, 5), (3, 16)]
    bare = make.frame("topic_log", log), index(make, {1: 0}).withColumn("captured_us", logs.F.lit(None).cast("bigint"))
    with pytest.raises(ValueError):
        end_offsets_from_log(*bare)


def test_end_never_moves_back(make):
    log = [dict(topic="t", partition=0, offset=o, timestamp=EPOCH + timedelta(seconds=s)) for o, s in [(0, 5), (9, 6), (1, 15)]]
    ends = end_offsets_from_log(make.frame("topic_log", log), index(make, {1: 10, 2: 20}))
    assert rows(ends, "snapshot_id", "end_offset") == [(1, 10), (2, 10)]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_readers_apply_the_schema(make, tmp_path, fmt):
    tables = make.tables({1: {"g": {"t": {0: 5}}}}, {1: {"t": {0: 9}}})
    path = str(tmp_path / "group_offsets")
    tables.group_offsets.write.format(fmt).save(path)
    back = read_table(make.spark, "group_offsets", path, fmt)
    assert back.schema == SCHEMAS["group_offsets"]
    assert back.collect() == tables.group_offsets.collect()


def test_load_and_prune(make, tmp_path):
    tables = make.tables({s: {"g": {"t": {0: s}}} for s in (1, 2, 3)}, {s: {"t": {0: 9}} for s in (1, 2, 3)})
    for name in ("group_offsets", "topic_offsets"):
        getattr(tables, name).write.partitionBy("snapshot_id").parquet(f"{tmp_path}/{name}")
    loaded = LagTables.load(make.spark, str(tmp_path))
    assert loaded.groups is None and loaded.brokers is None
    last = loaded.latest_pair()
    assert rows(last.group_offsets, "snapshot_id") == [(2,), (3,)]
    plan = last.group_offsets._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan
    assert len(last.group_offsets.inputFiles()) == 3  # the listing; the filter prunes at run time


def test_index_covers_every_table(make):
    tables = make.tables({1: {"g": {"t": {0: 1}}}}, {2: {"t": {0: 1}}}, groups=[dict(snapshot_id=7, group_id="g")])
    assert rows(snapshot_index(tables), "snapshot_seq", "snapshot_id") == [(0, 1), (1, 2), (2, 7)]


def stable_by_hand(records, polls):
    """records (topic, partition, producer, offset, second, control), in the order of their offsets."""
    out = {}
    for s, t in polls:
        seen = [r for r in records if r[4] <= t]
        for key in {(r[0], r[1]) for r in seen}:
            own, opened = [r for r in seen if (r[0], r[1]) == key], {}
            for _, _, producer, offset, _, control in own:
                if control:
                    opened.pop(producer, None)
                elif producer is not None:
                    opened.setdefault(producer, offset)
            out[(s, *key)] = min([own[-1][3] + 1, *opened.values()])
    return out


def test_last_stable_offsets(spark):
    rng, records, offsets = random.Random(6), [], {}
    for second in range(120):
        key = (rng.choice("xy"), rng.randrange(3))
        offset = offsets[key] = offsets.get(key, -1) + 1
        producer = rng.choice([None, 1, 2, 3])
        control = producer is not None and rng.random() < 0.3
        records.append((*key, producer, offset, second, control if producer else rng.choice([None, False])))
    polls = [(i, t) for i, t in enumerate((5, 6, 30, 31, 60, 90, 119, 200))]
    log = spark.createDataFrame(
        [(t, p, w, o, EPOCH + timedelta(seconds=s), c) for t, p, w, o, s, c in records],
        "topic string, partition int, producer_id long, offset long, timestamp timestamp, control boolean",
    )
    times = spark.createDataFrame([(i, EPOCH + timedelta(seconds=t)) for i, t in polls], "snapshot_id long, t timestamp")
    index = times.select("snapshot_id", F.col("snapshot_id").alias("snapshot_seq"), F.unix_micros("t").alias("captured_us"))
    got = end_offsets_from_log(log, index, "read_committed")
    found = {(r.snapshot_id, r.topic, r.partition): r.end_offset for r in got.collect()}
    assert found == stable_by_hand(records, polls)
    last = {(r.snapshot_id, r.topic, r.partition): r.end_offset for r in end_offsets_from_log(log, index).collect()}
    assert last.keys() == found.keys() and sum(last[k] > found[k] for k in found) > 5
    # Without transactions both are the same.
    plain = log.withColumn("producer_id", F.lit(None).cast("long"))
    rows = end_offsets_from_log(plain, index, "read_committed").collect()
    assert {(r.snapshot_id, r.topic, r.partition): r.end_offset for r in rows} == last
    with pytest.raises(ValueError):
        end_offsets_from_log(log, index, "read_all")
