"""Whole polls on a stream: closing rows, medians, pairs, options that change, logs."""

import os
import random
from datetime import timedelta

import pytest
from conftest import EPOCH
from pyspark.sql import functions as F
from test_streaming import RATE_COLUMNS, ROWS, arrive, batch, by_snapshot, polls, same

from tidemark import Options
from tidemark.operators.clean import prepare
from tidemark.operators.lag import lag_stats
from tidemark.operators.rates import rates
from tidemark.schemas import SCHEMAS
from tidemark.sources.logs import committed_offsets_from_log, end_offsets_from_log
from tidemark.streaming import windows
from tidemark.streaming.closed import ClosedPolls, Control, closed_polls
from tidemark.streaming.logs import OffsetsAtPolls, committed_points, end_offset_points
from tidemark.streaming.loop import append_parquet, tables_of

at = lambda seconds: EPOCH + timedelta(seconds=seconds)
STATS = ["snapshot_id", "group_id", "topic", "n_parts", "lag_min", "lag_max", "lag_sum", "lag_median", "par", "cv"]


def closing(seconds):
    return [(None, at(seconds), None, None, None, None, None)]


def files(spark, folder, schema, parts):
    """A stream of one file per part, read one by one in this order."""
    os.makedirs(folder)
    names = [f.split()[0] for f in schema.split(", ")] if isinstance(schema, str) else schema.names
    for i, part in enumerate(parts):
        made = f"{folder}-{i}"
        spark.createDataFrame([tuple(r) for r in part], schema).select(*names).coalesce(1).write.parquet(made)
        (name,) = [f for f in os.listdir(made) if f.endswith(".parquet")]
        os.rename(f"{made}/{name}", f"{folder}/{i:04d}.parquet")
        os.utime(f"{folder}/{i:04d}.parquet", (1_700_000_000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def offset_streams(spark, tmp_path, data, end=None):
    """Both offset tables as streams, one file per poll, with a closing row if asked for."""
    tables, streams = tables_of(spark.createDataFrame(data, ROWS)), []
    for name in ("group_offsets", "topic_offsets"):
        rows = getattr(tables, name).select(*SCHEMAS[name].names).collect()
        parts = [[r for r in rows if r.snapshot_id == s] for s in sorted({r.snapshot_id for r in rows})]
        if end is not None:
            parts.append([tuple(end if c == "captured_at" else None for c in SCHEMAS[name].names)])
        streams.append(files(spark, str(tmp_path / name), SCHEMAS[name], parts))
    return streams


def test_a_closing_row_ends_the_last_pair(spark, tmp_path):
    data = polls([10 * i for i in range(4)])
    stream = arrive(spark, str(tmp_path / "in"), [*by_snapshot(data), closing(50)])
    out = str(tmp_path / "res")
    append_parquet(windows.streaming_rates(stream, 10, "0 seconds"), out).awaitTermination()
    same(spark.read.parquet(f"{out}/out"), rates(batch(spark, data)), RATE_COLUMNS)


def test_a_closing_row_ends_the_last_lag(spark, tmp_path):
    data = polls([10 * i for i in range(4)])
    streams, out = offset_streams(spark, tmp_path, data, at(60)), str(tmp_path / "res")
    lag = windows.streaming_lag(windows.snapshot_rows(*streams, 10, "0 seconds", shares=2))
    append_parquet(lag, out).awaitTermination()
    columns = [c for c in STATS if c != "lag_median"]
    same(spark.read.parquet(f"{out}/out"), lag_stats(batch(spark, data)), columns)


def wide_polls(n, width):
    rng = random.Random(7)
    return [
        (s, at(10 * s), g, "wide", p, 1000 * s - rng.randrange(1 << rng.randrange(1, 40)), 1000 * s)
        for s in range(1, n + 1) for g in ("g1", "g2") for p in range(width)
    ]


def test_medians_of_closed_polls_equal_batch(spark, tmp_path):
    data = [r for r in wide_polls(3, 5000) if r[5] >= 0] + [
        (s, at(10 * s), "g3", "narrow", p, s, 9 * s + p) for s in (1, 3) for p in range(4)
    ]
    sink = ClosedPolls(lambda t, o: lag_stats(prepare(t, o)), str(tmp_path / "res"))
    query = sink.run(closed_polls(*offset_streams(spark, tmp_path, data, at(50)), 10, "0 seconds"))
    query.awaitTermination()
    want = lag_stats(batch(spark, data))
    assert want.filter("lag_median is not null").count() == want.count() > 5
    same(sink.results(spark), want, STATS)
    assert sink.taken == 3


def test_repeated_and_split_polls(spark, tmp_path):
    """Files that come twice, and polls that come in parts, change nothing."""
    data = polls([10 * i for i in range(4)])
    tables, streams = tables_of(spark.createDataFrame(data, ROWS)), []
    for name in ("group_offsets", "topic_offsets"):
        rows = getattr(tables, name).select(*SCHEMAS[name].names).collect()
        parts = []
        for s in sorted({r.snapshot_id for r in rows}):
            own = [r for r in rows if r.snapshot_id == s]
            parts += [own[::2], own, own[1::2]] if name == "group_offsets" else [own]
        parts.append([tuple(at(70) if c == "captured_at" else None for c in SCHEMAS[name].names)])
        streams.append(files(spark, str(tmp_path / name), SCHEMAS[name], parts))
    sink = ClosedPolls(lambda t, o: rates(prepare(t, o)), str(tmp_path / "res"), pairs=True)
    sink.run(closed_polls(*streams, 10, "0 seconds")).awaitTermination()
    same(sink.results(spark), rates(batch(spark, data)), RATE_COLUMNS)


def form(spark, data, end):
    """Rows of closed polls as one batch."""
    tables = tables_of(spark.createDataFrame([r for r in data if r[0] <= end], ROWS))
    named = lambda df, kind, group, offset: df.select(
        "snapshot_id", "captured_at", F.lit(kind).alias("kind"), group.alias("group_id"), "topic", "partition",
        F.col(offset).alias("offset"), "error",
    )
    return named(tables.group_offsets, "group", F.col("group_id"), "committed_offset").unionByName(
        named(tables.topic_offsets, "topic", F.lit(None).cast("string"), "end_offset")
    )


def test_repeated_micro_batch_and_counts(spark, tmp_path):
    data = polls([0, 3, 4, 11])
    sink = ClosedPolls(lambda t, o: rates(prepare(t, o)), str(tmp_path / "res"), pairs=True)
    every = form(spark, data, 9)
    for i, s in enumerate((1, 2, 3, 4)):
        one = every.filter(F.col("snapshot_id") == s)
        sink(one, 2 * i)
        sink(one, 2 * i)
        sink(one.limit(0), 2 * i + 1)  # a micro-batch without a closed poll
    same(sink.results(spark), rates(batch(spark, data)), RATE_COLUMNS)
    fresh = ClosedPolls(sink.analyse, sink.folder, pairs=True, options=Options(max_pairs=1))
    fresh(every.filter("snapshot_id > 1"), 1)  # another process goes on after micro-batch 0
    assert fresh.taken == 4 and fresh.results(spark).filter("snapshot_id > 2").count() > 0


def test_options_change_on_a_running_stream(spark, tmp_path):
    data = polls([10 * i for i in range(8)])
    control = Control(str(tmp_path / "control"))
    assert control.versions(spark) == []
    only = Options(include="g[12]", eta_method="simple")
    assert control.change(spark, at(20), only) == 1  # polls 3 and later
    assert control.change(spark, at(40), only, paused=True) == 2  # 5 and 6 are not taken
    assert control.change(spark, at(60), Options()) == 3
    streams = offset_streams(spark, tmp_path, data, at(100))
    sink = ClosedPolls(
        lambda t, o: rates(prepare(t, o)), str(tmp_path / "res"), pairs=True, control=control
    )
    sink.run(closed_polls(*streams, 10, "0 seconds")).awaitTermination()
    kept = [r for r in data if r[0] not in (5, 6)]
    usual, changed = (rates(prepare(tables_of(spark.createDataFrame(kept, ROWS)), o)) for o in (Options(), only))
    want = usual.filter("snapshot_id not in (3, 4)").unionByName(changed.filter("snapshot_id in (3, 4)"))
    same(sink.results(spark), want, RATE_COLUMNS)
    assert sink.results(spark).filter("snapshot_id = 7 and prev_snapshot_id = 4").count() > 0
    # A version written while the stream runs holds for polls taken from then on.
    assert Control.at(control.versions(spark), at(61), only)[0] == 3 and sink.taken == 6


def test_budget_of_polls_and_trigger(spark, tmp_path):
    data = polls([10 * i for i in range(7)])
    streams = offset_streams(spark, tmp_path, data, at(90))
    sink = ClosedPolls(lambda t, o: rates(prepare(t, o)), str(tmp_path / "res"), pairs=True, polls=4)
    query = sink.run(closed_polls(*streams, 10, "0 seconds"), processingTime="100 milliseconds")
    sink.until_done(query)
    assert not query.isActive and sink.taken == 4
    same(sink.results(spark), rates(batch(spark, data)).filter("snapshot_id <= 4"), RATE_COLUMNS)


def log_parts(committed):
    """Records of four periods of 10 s and marks at their ends; poll 3 has no record."""
    rng, parts, offsets = random.Random(3), [], {}
    for s in (1, 2, 3, 4):
        part = []
        for _ in range(0 if s == 3 else 30):
            key = (*(["g%d" % rng.randrange(2)] if committed else []), rng.choice("xy"), rng.randrange(3))
            offsets[key] = offsets.get(key, -1) + 1 if not committed else rng.randrange(100)
            part.append((*key, offsets[key], at(10 * s - rng.choice([0, 1, 5, 9.999999]))))
        if not committed:  # record times need not follow the offsets
            part.append(("x", 0, -1, at(10 * s)))
        parts += [part, [(*[None] * (3 if committed else 2), s, at(10 * s))]]
    return [p for p in parts if p]


@pytest.mark.parametrize("committed", [False, True])
def test_logs_on_a_stream_equal_batch(spark, tmp_path, committed):
    name = "commit_log" if committed else "topic_log"
    schema = SCHEMAS[name]
    keys = ["group_id", "topic", "partition"] if committed else ["topic", "partition"]
    time, value = ("commit_ts", "committed_offset") if committed else ("timestamp", "end_offset")
    order = ", ".join(f"{f.name} {f.dataType.simpleString()}" for c in [*keys, "offset", time] for f in schema if f.name == c)
    parts = log_parts(committed)
    end = [(*[None] * (len(keys) + 1), at(50))]
    stream = files(spark, str(tmp_path / "log"), order, [*parts, end])
    points = (committed_points if committed else end_offset_points)(stream, 10, "0 seconds")
    sink = OffsetsAtPolls(str(tmp_path / "res"), committed)
    sink.run(points).awaitTermination()
    rows = spark.createDataFrame([r for p in parts for r in p], order)
    log = rows.filter("topic is not null")
    marks = rows.filter("topic is null").select(
        F.col("offset").alias("snapshot_id"), F.col("offset").alias("snapshot_seq"), F.unix_micros(time).alias("captured_us")
    )
    want = (committed_offsets_from_log if committed else end_offsets_from_log)(log, marks)
    same(sink.results(spark), want, ["snapshot_id", "captured_at", *keys, value])
    assert sink.results(spark).filter("snapshot_id = 3").count() == want.filter("snapshot_id = 2").count()


def test_polls_are_held_in_files_not_in_keyed_state(spark, tmp_path):
    """No state operator; a late row is dropped; rows of released polls are deleted; micro-batches
    are analysed with the settings of the session that started the stream."""
    data, seen = polls([10 * i for i in range(5)]), []
    first, rest = by_snapshot(data)[0], by_snapshot(data)[1:]

    def analyse(t, o):
        seen.append(t.group_offsets.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return prepare(t, o).offsets

    tables, streams = tables_of(spark.createDataFrame(data, ROWS)), []
    for name in ("group_offsets", "topic_offsets"):
        found = getattr(tables, name).select(*SCHEMAS[name].names).collect()
        parts = [[r for r in found if r.snapshot_id == s[0][0]] for s in [*rest, first]]
        parts.append([tuple(at(90) if c == "captured_at" else None for c in SCHEMAS[name].names)])
        streams.append(files(spark, str(tmp_path / name), SCHEMAS[name], parts))
    sink = ClosedPolls(analyse, str(tmp_path / "res"))
    query = sink.run(closed_polls(*streams, 10, "0 seconds"))
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    assert {r.snapshot_id for r in sink.results(spark).collect()} == {2, 3, 4, 5}
    assert set(seen) == {"true"}
    assert len(os.listdir(tmp_path / "res" / "held")) < len(query.recentProgress)


def test_log_records_are_held_in_files_not_in_keyed_state(spark, tmp_path):
    """No state operator, late records are dropped, and a repeated micro-batch replaces its output."""
    order = "topic string, partition int, offset bigint, timestamp timestamp"
    parts = [
        [("x", 0, 0, at(5)), ("x", 1, 4, at(9))], [(None, None, 1, at(10))], [("x", 0, 3, at(15))],
        [("x", 0, 99, at(2))], [(None, None, 2, at(20)), (None, None, None, at(40))],
    ]
    stream = files(spark, str(tmp_path / "log"), order, parts)
    sink = OffsetsAtPolls(str(tmp_path / "res"))
    query = sink.run(end_offset_points(stream, 10, "0 seconds"))
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    want = [(1, 0, 1), (1, 1, 5), (2, 0, 4), (2, 1, 5)]
    found = lambda: sorted(map(tuple, sink.results(spark).select("snapshot_id", "partition", "end_offset").collect()))
    assert found() == want
    sink(end_offset_points(spark.createDataFrame(parts[-1], order), 10, "0 seconds"), len(parts) - 1)
    assert found() == want
