"""Snapshot tables from the logs themselves, for users who keep records, not polls.

Each record goes to the first snapshot taken at or after it; the records of one snapshot
combine before the shuffle, and snapshots without a record take over the value before.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_sequence
from tidemark.session import fixed
from tidemark.sources.snapshots import BROADCAST_POLLS

# Bounds of stretches of polls that are known to the driver and sent with every task: half
# a megabyte at most.
STRETCHES = 1 << 16


class _Polls:
    """The list of polls in stretches of equally many, whatever the time between them.

    stretches  stretch, times (rising), seqs: at most STRETCHES rows of n / STRETCHES polls
    bounds     the last time of each stretch
    last_seq   the last number
    """

    def __init__(self, snapshots: DataFrame):
        self.n, self.last_seq = snapshots.agg(F.count("*"), F.max("snapshot_seq")).first()
        if not self.n:
            raise ValueError("no snapshots")
        length = -(-self.n // STRETCHES)
        # Of polls at the same time the first one gets the records.
        timed = snapshots.groupBy("captured_us").agg(F.min("snapshot_seq").alias("seq"))
        numbered = dense_sequence(timed.filter("captured_us is not null"), "captured_us", "_n")
        poll = F.sort_array(F.collect_list(F.struct("captured_us", "seq")))
        self.stretches = fixed(
            numbered.groupBy(F.expr(f"_n div {length}").cast("int").alias("stretch"))
            .agg(poll.alias("polls"))
            .select(
                "stretch",
                F.col("polls.captured_us").alias("times"),
                F.col("polls.seq").alias("seqs"),
            )
        )
        ends = self.stretches.select("stretch", F.element_at("times", -1).alias("end"))
        self.bounds = [r.end for r in ends.orderBy("stretch").collect()]
        if not self.bounds:
            raise ValueError("snapshots without a time")


def _assign(log: DataFrame, time: Column, polls: _Polls) -> DataFrame:
    """Add snapshot_seq: the first snapshot at or after `time`.

    A record finds its stretch by binary search in the bounds, and meets exactly one row:
    that stretch, whose few polls it is compared with. So uneven polls make no candidates.
    Records after the last snapshot belong to none.
    """
    # Buckets are closed on the left, stretches on the right; whole microseconds, which a
    # double holds exactly up to the year 2255.
    bounds = [float("-inf"), *map(float, polls.bounds), float("inf")]
    search = Bucketizer(splits=bounds, inputCol="_at", outputCol="_bucket", handleInvalid="skip")
    timed = log.withColumn("_us", F.unix_micros(time)).filter("_us is not null")
    records = search.transform(timed.withColumn("_at", (F.col("_us") - 1).cast("double")))
    stretches = polls.stretches
    if polls.n <= BROADCAST_POLLS:
        stretches = F.broadcast(stretches)
    earlier = F.size(F.filter("times", lambda t: t < F.col("_us")))
    return (
        records.withColumn("stretch", F.col("_bucket").cast("int"))
        .join(stretches, "stretch")
        .withColumn("snapshot_seq", F.element_at("seqs", earlier + 1))
    )


def _fill(points: DataFrame, keys: list[str], value: str, last_seq: int) -> DataFrame:
    """One row per key and snapshot from the first value on; a key has at most one point
    per snapshot here, so its window is no longer than the list of snapshots."""
    order = Window.partitionBy(*keys).orderBy("snapshot_seq")
    until = F.coalesce(F.lead("snapshot_seq").over(order) - 1, F.lit(last_seq))
    return points.withColumn("_until", until).select(
        *keys, value, F.explode(F.sequence("snapshot_seq", "_until")).alias("snapshot_seq")
    )


def _stamped(filled: DataFrame, snapshots: DataFrame, polls: _Polls) -> DataFrame:
    if polls.n <= BROADCAST_POLLS:
        snapshots = F.broadcast(snapshots)
    return (
        filled.join(snapshots, "snapshot_seq")
        .withColumn("captured_at", F.timestamp_micros("captured_us"))
        .withColumn("error", F.lit(None).cast("string"))
    )


READ_UNCOMMITTED, READ_COMMITTED = "read_uncommitted", "read_committed"


def end_offsets_from_log(
    log: DataFrame, snapshots: DataFrame, isolation: str = READ_UNCOMMITTED
) -> DataFrame:
    """topic_offsets from a topic log: the offset after the last record so far.

    With READ_COMMITTED the last stable offset, as a reader of committed records sees it: the
    first offset of the transactions that are open at the poll, where there are any. The log then
    has producer_id (null: outside transactions) and control (true: a marker that commits or aborts
    what its producer has written to the partition since its last one).
    """
    if isolation not in (READ_UNCOMMITTED, READ_COMMITTED):
        raise ValueError(f"isolation must be {READ_UNCOMMITTED} or {READ_COMMITTED}")
    polls = _Polls(snapshots)
    keys = ["partition", "topic"]  # the one that differs most leads the sorts
    slim = log.select(*keys, "offset", "timestamp")
    points = (
        _assign(slim, F.col("timestamp"), polls)
        .groupBy(*keys, "snapshot_seq")
        .agg((F.max("offset") + 1).alias("end_offset"))
    )
    # Record times need not follow the offsets: the end never moves back.
    so_far = Window.partitionBy(*keys).orderBy("snapshot_seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    points = points.withColumn("end_offset", F.max("end_offset").over(so_far))
    filled = _fill(points, keys, "end_offset", polls.last_seq)
    if isolation == READ_COMMITTED:
        open_ones = _open_transactions(log, polls).groupBy(*keys, "snapshot_seq")
        stable = open_ones.agg(F.min("first").alias("stable"))
        filled = filled.join(stable, [*keys, "snapshot_seq"], "left").withColumn(
            "end_offset", F.least("end_offset", F.coalesce("stable", "end_offset"))
        )
    return _stamped(filled, snapshots, polls).select(
        "snapshot_id", "captured_at", "topic", "partition", "end_offset", "error"
    )


def _open_transactions(log: DataFrame, polls: _Polls) -> DataFrame:
    """topic, partition, producer_id, snapshot_seq and `first`: the first offset of every
    transaction that is open at a poll.

    Records combine per producer and poll: the last marker, and the first record behind it. So a
    window has one row per poll, whatever a producer writes; a transaction lasts from its poll to
    that of the next marker.
    """
    own = ["topic", "partition", "producer_id"]
    slim = log.filter("producer_id is not null").select(
        *own, "offset", "timestamp", F.coalesce("control", F.lit(False)).alias("control")
    )
    placed = _assign(slim, F.col("timestamp"), polls).select(*own, "snapshot_seq", "offset", "control")
    at = [*own, "snapshot_seq"]
    ended = placed.filter("control").groupBy(*at).agg(F.max("offset").alias("ended"))
    behind = placed.filter("not control").join(ended, at, "left")
    first = behind.filter("ended is null or offset > ended").groupBy(*at).agg(F.min("offset").alias("first"))
    states = ended.join(first, at, "full")
    order = Window.partitionBy(*own).orderBy("snapshot_seq")
    upto = (Window.unboundedPreceding, Window.currentRow)
    states = states.withColumn("_done", F.count("ended").over(order.rowsBetween(*upto)))
    since = Window.partitionBy(*own, "_done").orderBy("snapshot_seq").rowsBetween(*upto)
    states = states.withColumn("first", F.min("first").over(since))
    return _fill(states, own, "first", polls.last_seq).filter("first is not null")


def committed_offsets_from_log(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """group_offsets from a commit log: the last commit so far (the largest offset among
    commits with the same time)."""
    polls = _Polls(snapshots)
    keys = ["partition", "group_id", "topic"]
    slim = log.select(*keys, "offset", "commit_ts")
    points = (
        _assign(slim, F.col("commit_ts"), polls)
        .groupBy(*keys, "snapshot_seq")
        .agg(F.max(F.struct("_us", "offset")).alias("_last"))
        .withColumn("committed_offset", F.col("_last.offset"))
    )
    filled = _fill(points, keys, "committed_offset", polls.last_seq)
    return _stamped(filled, snapshots, polls).select(
        "snapshot_id", "captured_at", "group_id", "topic", "partition", "committed_offset", "error"
    )
