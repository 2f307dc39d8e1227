import os
import random
from datetime import timedelta

import pytest
from conftest import EPOCH
from pyspark.sql import functions as F

from tidemark import Options
from tidemark.operators.clean import prepare
from tidemark.operators.lag import lag_stats
from tidemark.operators.rates import rates
from tidemark.schemas import SCHEMAS
from tidemark.streaming import windows
from tidemark.streaming.loop import SnapshotLoop, append_parquet, tables_of

ROWS = (
    "snapshot_id bigint, captured_at timestamp, group_id string, topic string, partition int, "
    "committed_offset bigint, end_offset bigint"
)
RATE_COLUMNS = [
    "snapshot_id", "prev_snapshot_id", "group_id", "topic", "time_delta", "events_consumed",
    "consumption_rate", "arrival_rate", "lag_sum", "remaining_sec", "remaining_hms",
]


def polls(times):
    """Snapshot rows with vanishing, new and uncommitted partitions and missing groups."""
    rng, data = random.Random(2), []
    for s, t in enumerate(times, 1):
        at = EPOCH + timedelta(seconds=t)
        ends = {(topic, p): 1000 * s + rng.randrange(900) for topic in "xy" for p in range(4)}
        for g in ("g1", "g2", "g3"):
            if rng.random() < 0.15:
                continue
            for (topic, p), end in ends.items():
                if rng.random() < 0.8:
                    offset = rng.choice([-1, end - rng.randrange(800), end + 1])
                    data.append((s, at, g, topic, p, offset, end))
    return data


def arrive(spark, folder, chunks):
    """One file per chunk, in order."""
    os.makedirs(folder)
    for i, chunk in enumerate(chunks):
        part = f"{folder}/../part-{os.path.basename(folder)}-{i}"
        spark.createDataFrame(chunk, ROWS).coalesce(1).write.parquet(part)
        (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        target = f"{folder}/{i:04d}.parquet"
        os.rename(f"{part}/{name}", target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)


def by_snapshot(data):
    return [[r for r in data if r[0] == s] for s in sorted({r[0] for r in data})]


def batch(spark, data):
    return prepare(tables_of(spark.createDataFrame(data, ROWS)))


def same(got, want, columns):
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(
        map(tuple, want.select(columns).collect()), key=repr
    )


def test_rates_of_periodic_polls_equal_batch(spark, tmp_path):
    data = polls([10 * i for i in range(7)])
    stream = arrive(spark, str(tmp_path / "in"), by_snapshot(data))
    out = str(tmp_path / "res")
    append_parquet(windows.streaming_rates(stream, 10, "0 seconds"), out).awaitTermination()
    closed = rates(batch(spark, data)).filter("snapshot_id < 7")
    assert closed.count() > 10
    same(spark.read.parquet(f"{out}/out"), closed, RATE_COLUMNS)


def test_lag_of_two_streams_equals_batch(spark, tmp_path):
    data = polls([10 * i for i in range(5)])
    tables = tables_of(spark.createDataFrame(data, ROWS))
    streams = []
    for name in ("group_offsets", "topic_offsets"):
        frame = getattr(tables, name).select(*SCHEMAS[name].names)
        frame.repartition(3).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(SCHEMAS[name]).parquet(str(tmp_path / name)))
    out = str(tmp_path / "res")
    lag = windows.streaming_lag(windows.snapshot_rows(*streams, 10, "0 seconds"))
    append_parquet(lag, out).awaitTermination()
    columns = ["snapshot_id", "group_id", "topic", "n_parts", "lag_min", "lag_max", "lag_sum", "par", "cv"]
    same(spark.read.parquet(f"{out}/out"), lag_stats(batch(spark, data)).filter("snapshot_id < 5"), columns)


def test_late_rows_are_dropped(spark, tmp_path):
    data = polls([10 * i for i in range(6)])
    first, rest = by_snapshot(data)[0], by_snapshot(data)[1:]
    stream = arrive(spark, str(tmp_path / "in"), [*rest, first])
    out = str(tmp_path / "res")
    append_parquet(windows.streaming_rates(stream, 10, "0 seconds"), out).awaitTermination()
    ids = {r.snapshot_id for r in spark.read.parquet(f"{out}/out").select("snapshot_id").collect()}
    assert ids == {3, 4, 5}


@pytest.mark.parametrize("cut", ["whole", "split"])
def test_loop_at_irregular_times_equals_batch(spark, tmp_path, cut):
    data = polls([0, 3, 4, 11, 30])
    chunks = by_snapshot(data)
    if cut == "split":  # snapshots spread over micro-batches
        flat = [r for c in chunks for r in c]
        chunks = [flat[i : i + 7] for i in range(0, len(flat), 7)]
    loop = SnapshotLoop(lambda t: rates(prepare(t)), str(tmp_path / "loop"))
    query = loop.run(arrive(spark, str(tmp_path / "in"), chunks))
    query.awaitTermination()
    before = loop.results(spark).select("snapshot_id").distinct().count()
    loop.finish(spark, query.lastProgress["batchId"])
    same(loop.results(spark), rates(batch(spark, data)), RATE_COLUMNS)
    assert before == 3  # the newest poll was still open


def test_repeated_micro_batch_replaces_its_output(spark, tmp_path):
    data = polls([0, 3, 4, 11])
    loop = SnapshotLoop(lambda t: rates(prepare(t)), str(tmp_path / "loop"))
    chunks = [spark.createDataFrame(c, ROWS) for c in by_snapshot(data)]
    for i, chunk in enumerate(chunks):
        loop(chunk, i)
        loop(chunk, i)
    loop.finish(spark, len(chunks) - 1)
    same(loop.results(spark), rates(batch(spark, data)), RATE_COLUMNS)


def test_loop_writes_new_rows_only(spark, tmp_path):
    """Micro-batches that come in parts write their own rows; what is not needed goes."""
    data = polls([0, 3, 4, 11])
    loop = SnapshotLoop(lambda t: rates(prepare(t)), str(tmp_path / "loop"))
    parts = [c[k::3] for c in by_snapshot(data) for k in range(3)]
    for i, part in enumerate(parts):
        loop(spark.createDataFrame(part, ROWS), i)
        assert spark.read.parquet(f"{tmp_path}/loop/carried/{i}").count() == len(part)
    held = {int(f) for f in os.listdir(tmp_path / "loop" / "carried")}
    assert held == set(range(6, 12))  # the last finished poll and the open one
    loop.finish(spark, len(parts) - 1)
    same(loop.results(spark), rates(batch(spark, data)), RATE_COLUMNS)


def test_loop_ignores_rows_of_finished_polls(spark, tmp_path):
    data = polls([0, 3, 4])
    loop = SnapshotLoop(lambda t: rates(prepare(t)), str(tmp_path / "loop"))
    one, two, three = [spark.createDataFrame(c, ROWS) for c in by_snapshot(data)]
    loop(one, 0)
    loop(two, 1)
    loop(one.unionByName(three), 2)
    loop.finish(spark, 2)
    same(loop.results(spark), rates(batch(spark, data)), RATE_COLUMNS)


@pytest.mark.parametrize(
    "options",
    [Options(pairing="disjoint"), Options(max_pairs=2), Options(max_pairs=1, pairing="disjoint")],
)
def test_loop_counts_polls_like_batch(spark, tmp_path, options):
    data = polls([0, 3, 4, 11, 30, 31])
    loop = SnapshotLoop(lambda t: rates(prepare(t, options)), str(tmp_path / "loop"))
    for i, chunk in enumerate(by_snapshot(data)):  # one poll per micro-batch
        loop(spark.createDataFrame(chunk, ROWS), i)
    loop.finish(spark, i)
    tables = tables_of(spark.createDataFrame(data, ROWS))
    same(loop.results(spark), rates(prepare(tables, options)), RATE_COLUMNS)


def test_loop_hides_empty_groups(spark, tmp_path):
    data = polls([0, 3, 4])
    gone = data[0][2]
    state = F.when(F.col("group_id") == gone, "Empty").otherwise("Stable")
    loop = SnapshotLoop(lambda t: rates(prepare(t)), str(tmp_path / "loop"))
    for i, chunk in enumerate(by_snapshot(data)):
        loop(spark.createDataFrame(chunk, ROWS).withColumn("raw_state", state), i)
    loop.finish(spark, i)
    groups = {r.group_id for r in loop.results(spark).collect()}
    assert groups == {r[2] for r in data} - {gone}


def test_loop_analyses_in_the_session_it_was_started_from(spark, tmp_path):
    """Spark turns adaptive execution off in a micro-batch's own session."""
    seen = []

    def analyse(t):
        seen.append(t.group_offsets.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return rates(prepare(t))

    loop = SnapshotLoop(analyse, str(tmp_path / "loop"))
    loop.run(arrive(spark, str(tmp_path / "in"), by_snapshot(polls([0, 3, 4])))).awaitTermination()
    assert set(seen) == {"true"}
