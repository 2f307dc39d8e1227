"""Consumption and arrival rates between two snapshots, and the time to catch up.

Neighbouring snapshots meet in blocks (see `ordering.blocked`): the rows are shuffled once
by (block, chunk, group, topic), where at most (BLOCK + 1) * CHUNK rows can share a key,
and everything per partition happens there. What goes on from there is one row per
snapshot, group and topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.text import hms, legacy_hms
from tidemark.operators.clean import Prepared
from tidemark.operators.lag import lag_value, merge_columns, stat_columns, with_shape
from tidemark.operators.ordering import blocked, in_home_block, with_chunk

_PAIR = ["snapshot_id", "prev_snapshot_id"]
# Largest ETA in seconds; casting a larger double to bigint would fail.
_MAX_ETA = 9.2e18


def _is_next(later: str = "next_seq") -> Column:
    return F.col(later) == F.col("snapshot_seq") + 1


def _pair_filter(prepared: Prepared, first: Column | None = None) -> Column:
    """Which neighbours form a pair, told from the sequence number of the first."""
    options = prepared.options
    first = F.col("snapshot_seq") if first is None else first
    keep = F.lit(True)
    if options.pairing == "disjoint":
        keep = first % 2 == 0
    if options.pair_limit is not None:
        step = 2 if options.pairing == "disjoint" else 1
        keep = keep & (first < step * options.pair_limit)
    return keep


def _timed(df: DataFrame, prepared: Prepared) -> DataFrame:
    """Adds number and time of the poll. A poll that the list lacks stops the query: without
    its number its rows would be lost."""
    joined = df.join(prepared.snapshots, "snapshot_id", "left")
    unknown = F.concat(
        F.lit("poll "), F.col("snapshot_id").cast("string"), F.lit(" is not in the list of polls")
    )
    number = F.coalesce("snapshot_seq", F.raise_error(unknown).cast("bigint"))
    return joined.withColumn("snapshot_seq", number)


def _delta(later: str, earlier: str) -> Column:
    return (F.col(later) - F.col(earlier)) / F.lit(1e6)


def _neighbours(
    prepared: Prepared, towards: str, with_lag: bool, more: DataFrame | None = None
) -> DataFrame:
    """Committed rows next to the same partition's row in the neighbouring block position:
    columns near_seq, near_offset, near_us describe that row, if there is one. `more` has further
    columns of a partition; they come with its end offset, so the rows are not shuffled for them."""
    rows = prepared.committed
    if with_lag:
        ends = prepared.end_offsets
        if prepared.options.legacy:
            ends = ends.join(prepared.requested, S.PARTITION_KEY, "left_semi")
        if more is not None:
            ends = ends.join(more, S.JOIN_KEY, "left")
        rows = rows.join(ends, S.JOIN_KEY, "left").withColumn(
            "lag", lag_value(prepared.options.legacy)
        )
        # greatest() skips NULLs, so a lag needs both sides.
        both = F.col("end_offset").isNotNull() & F.col("committed_offset").isNotNull()
        rows = rows.withColumn("lag", F.when(both, F.col("lag")))
    place = ["block", "chunk", "group_id", "topic"]
    rows = blocked(with_chunk(_timed(rows, prepared)), towards=towards).repartition(prepared.tasks(), *place)
    # The partition leads, as it differs most: see JOIN_KEY.
    order = Window.partitionBy("partition", *place).orderBy("snapshot_seq")
    shift = F.lead if towards == "next" else F.lag
    near = F.struct("snapshot_seq", "committed_offset", "captured_us", "snapshot_id")
    return (
        rows.withColumn("_near", shift(near).over(order))
        .withColumn("near_seq", F.col("_near.snapshot_seq"))
        .withColumn("near_offset", F.col("_near.committed_offset"))
        .withColumn("near_us", F.col("_near.captured_us"))
        .withColumn("near_id", F.col("_near.snapshot_id"))
        .drop("_near")
    )


def partition_rates(prepared: Prepared) -> DataFrame:
    """Consumption rate of each partition that both snapshots of a pair have."""
    seconds = _delta("near_us", "captured_us")
    return (
        _neighbours(prepared, "next", with_lag=False)
        .filter(in_home_block() & _is_next("near_seq") & _pair_filter(prepared))
        .filter("committed_offset is not null and near_offset is not null")
        .filter(seconds != 0)
        .select(
            F.col("near_id").alias("snapshot_id"),
            F.col("snapshot_id").alias("prev_snapshot_id"),
            "group_id",
            "topic",
            "partition",
            F.col("committed_offset").alias("prev_offset"),
            F.col("near_offset").alias("committed_offset"),
            ((F.col("near_offset") - F.col("committed_offset")) / seconds).alias("rate"),
        )
    )


def group_rates(prepared: Prepared, with_lag: bool = True) -> DataFrame:
    """Consumption per pair, group and topic; with_lag adds the lag statistics of the
    second snapshot from the same pass over the rows.

    The partitions of the first snapshot drive: one that is missing in the second counts
    there as 0, one that is new in the second does not count. Both snapshots must have the
    group and the topic, if only with nothing committed.
    """
    legacy = prepared.options.legacy
    matched = F.when(
        F.col("committed_offset").isNotNull() & _is_next("near_seq"), F.col("near_offset")
    )
    parts = _neighbours(prepared, "next", with_lag).groupBy(
        "block", "chunk", "group_id", "topic", "snapshot_seq"
    )
    parts = parts.agg(
        F.max("snapshot_id").alias("snapshot_id"),
        F.max("captured_us").alias("captured_us"),
        F.sum("committed_offset").alias("first_sum"),
        F.sum(matched).alias("second_sum"),
        *(stat_columns() if with_lag else []),
    )
    topics = (
        parts.repartition("block", "group_id", "topic")
        .groupBy("block", "group_id", "topic", "snapshot_seq")
        .agg(
            F.max("snapshot_id").alias("snapshot_id"),
            F.max("captured_us").alias("captured_us"),
            F.coalesce(F.sum("first_sum"), F.lit(0)).alias("first_sum"),
            F.coalesce(F.sum("second_sum"), F.lit(0)).alias("second_sum"),
            *(merge_columns() if with_lag else []),
        )
    )
    lag_columns = ["n_parts", "lag_min", "lag_max", "lag_sum", "lag_sq"] if with_lag else []
    order = Window.partitionBy("block", "group_id", "topic").orderBy("snapshot_seq")
    second = F.struct("snapshot_seq", "snapshot_id", "captured_us", "first_sum", *lag_columns)
    consumed = F.col("second_sum") - F.col("first_sum")
    if legacy:
        # The first-generation tool sums each side on its own.
        consumed = F.col("_second.first_sum") - F.col("first_sum")
    pairs = (
        topics.withColumn("_second", F.lead(second).over(order))
        .withColumn("next_seq", F.col("_second.snapshot_seq"))
        .filter(in_home_block() & _is_next() & _pair_filter(prepared))
        .withColumn("time_delta", _delta("_second.captured_us", "captured_us"))
        .filter("time_delta <> 0")
    )
    rate = consumed / F.col("time_delta")
    pairs = pairs.select(
        F.col("_second.snapshot_id").alias("snapshot_id"),
        F.col("snapshot_id").alias("prev_snapshot_id"),
        "group_id",
        "topic",
        "time_delta",
        consumed.alias("events_consumed"),
        (F.bround(rate, 3) if legacy else rate).alias("consumption_rate"),
        *[F.col(f"_second.{c}").alias(c) for c in lag_columns],
    )
    if not with_lag:
        return pairs
    shaped = with_shape(pairs)
    # Nothing committed: the pair has no lag statistics at all.
    for name in ("par", "cv", "n_parts"):
        shaped = shaped.withColumn(name, F.when(F.col("n_parts") > 0, F.col(name)))
    return shaped


def topic_totals(prepared: Prepared) -> DataFrame:
    """Sum of the end offsets of the requested partitions per snapshot and topic. A topic
    that answered with errors only has the sum 0; one that did not answer has no row.

    Both inputs are stacked and counted by partition, so a topic that very many groups
    read shrinks to its partitions before the shuffle; no join, no hot key.
    """
    answers = prepared.answers.select(
        *S.PARTITION_KEY, "end_offset", F.lit(True).alias("answered"), F.lit(False).alias("asked")
    )
    asked = prepared.asked.select(
        *S.PARTITION_KEY,
        F.lit(None).cast("bigint").alias("end_offset"),
        F.lit(False).alias("answered"),
        F.lit(True).alias("asked"),
    )
    return (
        answers.unionByName(asked)
        .groupBy(*S.PARTITION_KEY)
        .agg(*[F.max(c).alias(c) for c in ("end_offset", "answered", "asked")])
        .groupBy("snapshot_id", "topic")
        .agg(
            F.coalesce(F.sum(F.when(F.col("asked"), F.col("end_offset"))), F.lit(0)).alias(
                "end_sum"
            ),
            F.max("answered").alias("answered"),
        )
        .filter("answered")
        .drop("answered")
    )


def arrival_rates(prepared: Prepared) -> DataFrame:
    """Arrivals per pair and topic. Each side is summed over all of its own requested
    partitions, and divided by the time between the group-offset captures."""
    rows = blocked(_timed(topic_totals(prepared), prepared))
    order = Window.partitionBy("block", "topic").orderBy("snapshot_seq")
    near = F.struct("snapshot_seq", "snapshot_id", "captured_us", "end_sum")
    seconds = _delta("_second.captured_us", "captured_us")
    arrived = F.col("_second.end_sum") - F.col("end_sum")
    rate = arrived / seconds
    return (
        rows.withColumn("_second", F.lead(near).over(order))
        .withColumn("next_seq", F.col("_second.snapshot_seq"))
        .filter(in_home_block() & _is_next() & _pair_filter(prepared))
        .filter(seconds != 0)
        .select(
            F.col("_second.snapshot_id").alias("snapshot_id"),
            F.col("snapshot_id").alias("prev_snapshot_id"),
            "topic",
            arrived.alias("events_arrived"),
            (F.bround(rate, 3) if prepared.options.legacy else rate).alias("arrival_rate"),
        )
    )


def eta_seconds(lag: Column, consumption: Column, arrival: Column, method: str) -> Column:
    """Seconds until the lag is gone, cut to an integer; -1 if it does not shrink.
    No lag statistics at all (NULL) gives 0."""
    speed = consumption - arrival if method == "net-rate" else consumption
    left = F.least(lag.cast("double") / speed, F.lit(_MAX_ETA)).cast("bigint")
    return F.when(lag.isNull(), 0).when(speed > 0, left).otherwise(-1).cast("bigint")


def rates(prepared: Prepared) -> DataFrame:
    """Everything about a pair of snapshots per group and topic: rates, ETA, and the lag
    statistics of the second snapshot (NULL where nothing is committed)."""
    options = prepared.options
    lag, used = F.col("lag_sum"), F.col("consumption_rate")
    pairs = group_rates(prepared)
    arrivals = arrival_rates(prepared).drop("events_arrived")
    if options.legacy:
        pairs = pairs.join(arrivals, [*_PAIR, "topic"])
        zeros = ["n_parts", "lag_min", "lag_max", "lag_sum", "lag_mean", "par", "cv"]
        pairs = pairs.na.fill(0, zeros)
        # The first-generation tool knows the simple ETA only, and keeps the fraction.
        remaining = F.when(used > 0, lag / used).otherwise(-1.0)
        text = legacy_hms(F.col("remaining_sec"))
    else:
        pairs = pairs.join(arrivals, [*_PAIR, "topic"], "left").withColumn(
            "arrival_rate", F.coalesce("arrival_rate", F.lit(0.0))
        )
        remaining = eta_seconds(lag, used, F.col("arrival_rate"), options.eta_method)
        # A row without lag statistics shows no time although its ETA is 0.
        text = F.when(lag.isNotNull(), hms(F.col("remaining_sec"))).otherwise("-")
    return (
        pairs.withColumn("remaining_sec", remaining)
        .withColumn("remaining_hms", text)
        .select(
            *_PAIR,
            "group_id",
            "topic",
            "time_delta",
            "events_consumed",
            "consumption_rate",
            "arrival_rate",
            "remaining_sec",
            "remaining_hms",
            "n_parts",
            "lag_min",
            "lag_max",
            "lag_sum",
            "lag_mean",
            "par",
            "cv",
        )
    )


def partition_history(
    prepared: Prepared, placed: bool = False, more: DataFrame | None = None
) -> DataFrame:
    """Rows of the second snapshot of every pair that have a lag, with the rate since the
    first snapshot (0 where that one lacks the partition). `placed` keeps block and chunk,
    by which the rows are distributed; `more` has further columns of a partition, one row each."""
    extra = [] if more is None else [c for c in more.columns if c not in S.PARTITION_KEY]
    seconds = _delta("captured_us", "near_us")
    moved = F.col("committed_offset") - F.col("near_offset")
    adjacent = F.col("near_seq") == F.col("snapshot_seq") - 1
    keep = (F.col("snapshot_seq") > 0) & _pair_filter(prepared, F.col("snapshot_seq") - 1)
    return (
        _neighbours(prepared, "previous", with_lag=True, more=more)
        .filter(in_home_block() & keep & F.col("lag").isNotNull())
        .withColumn(
            "rate", F.coalesce(F.when(adjacent & (seconds != 0), moved / seconds), F.lit(0.0))
        )
        .select(
            *S.STATS_KEY,
            "partition",
            "committed_offset",
            "end_offset",
            "lag",
            "rate",
            *extra,
            *(["block", "chunk"] if placed else []),
        )
    )


__all__ = [
    "arrival_rates",
    "eta_seconds",
    "group_rates",
    "partition_history",
    "partition_rates",
    "rates",
    "topic_totals",
]
