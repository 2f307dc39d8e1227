"""Lag and rates over streams of snapshot rows, with built-in windows only.

A snapshot row is one partition of one group at one poll: snapshot_id, captured_at,
group_id, topic, partition, committed_offset (NULL or negative = none), end_offset. Polls
come every `period` seconds, at multiples of it. Results appear once the watermark has
passed their window: with the next poll, or with a closing row (see `closed`) in the same source;
rows later than `delay` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import hms
from tidemark.operators.lag import stat_columns, with_shape
from tidemark.operators.rates import eta_seconds
from tidemark.streaming.closed import data_rows

# Shares that the groups of one topic are dealt into before a join with what the topic has
# once: streaming joins are not split at run time. Every share keeps a copy of the topic's side,
# so ask for more where one topic has very many groups. It is part of the state's layout: a
# running stream keeps the number it started with.
SHARES = 1


def _dealt(rows: DataFrame, shares: int) -> DataFrame:
    """Rows of groups, with the share their group belongs to."""
    return rows.withColumn("share", F.pmod(F.hash("group_id"), F.lit(shares)))


def _repeated(rows: DataFrame, shares: int) -> DataFrame:
    """Rows that every group of a topic needs, once for each share."""
    return rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))


def _offset() -> Column:
    return F.when(F.col("committed_offset") >= 0, F.col("committed_offset"))


def _lag() -> Column:
    both = _offset().isNotNull() & F.col("end_offset").isNotNull()
    zero = F.lit(0).cast("bigint")
    return F.when(both, F.greatest(F.col("end_offset") - _offset(), zero))


def snapshot_rows(
    group_offsets: DataFrame,
    topic_offsets: DataFrame,
    period: int,
    delay: str,
    shares: int = SHARES,
) -> DataFrame:
    """Join the two offset streams. Both captures of a poll must lie in the same period:
    the period is part of the key, which lets the state of old polls go. The groups of a
    partition are dealt into `shares`, each with its own copy of the end offset."""
    tick = lambda column: F.window(column, f"{period} seconds")
    committed = (
        data_rows(group_offsets.filter(F.col("error").isNull()).withWatermark("captured_at", delay))
        .select("*", tick("captured_at").alias("tick"))
        .drop("error")
    )
    ends = (
        data_rows(
            topic_offsets.filter(F.col("error").isNull())
            .withColumnRenamed("captured_at", "end_captured_at")
            .withWatermark("end_captured_at", delay),
            "end_captured_at",
        )
        .select(
            tick("end_captured_at").alias("tick"),
            "snapshot_id",
            "topic",
            "partition",
            "end_offset",
        )
    )
    keys = ["tick", "snapshot_id", "topic", "partition", "share"]
    return _dealt(committed, shares).join(_repeated(ends, shares), keys).drop("share")


def streaming_lag(rows: DataFrame) -> DataFrame:
    """Lag statistics per poll, group and topic from joined streams (`snapshot_rows`)."""
    stats = (
        rows.withColumn("lag", _lag())
        .filter(F.col("lag").isNotNull())
        .groupBy("tick", "snapshot_id", "group_id", "topic")
        .agg(*stat_columns())
    )
    return with_shape(stats).drop("tick")


def streaming_rates(
    rows: DataFrame,
    period: int,
    delay: str,
    eta_method: str = "net-rate",
    shares: int = SHARES,
) -> DataFrame:
    """Rates and ETA of every two neighbouring polls.

    Windows two periods long, one period apart: each holds exactly two polls. Partitions
    are matched inside the window first, then summed per group and topic; end offsets are
    counted once per partition, however many groups read it. The groups of a topic are dealt
    into `shares` before they meet its arrivals.
    """
    pair = F.window("captured_at", f"{2 * period} seconds", f"{period} seconds")
    paired = data_rows(rows.withWatermark("captured_at", delay)).select(
        "*", pair.alias("pair"), _offset().alias("offset"), _lag().alias("lag")
    )
    late = F.col("captured_at") >= F.col("pair.start") + F.expr(f"interval {period} seconds")
    first, second = lambda c: F.when(~late, c), lambda c: F.when(late, c)
    partitions = paired.groupBy("pair", "group_id", "topic", "partition").agg(
        F.max(first(F.col("offset"))).alias("o1"),
        F.max(second(F.col("offset"))).alias("o2"),
        F.max(second(F.col("lag"))).alias("lag"),
        F.max(first(F.unix_micros("captured_at"))).alias("us1"),
        F.max(second(F.unix_micros("captured_at"))).alias("us2"),
        F.max(first(F.col("snapshot_id"))).alias("id1"),
        F.max(second(F.col("snapshot_id"))).alias("id2"),
    )
    groups = partitions.groupBy("pair", "group_id", "topic").agg(
        F.coalesce(F.sum("o1"), F.lit(0)).alias("sum1"),
        F.coalesce(F.sum(F.when(F.col("o1").isNotNull(), F.col("o2"))), F.lit(0)).alias("sum2"),
        F.max("us1").alias("us1"),
        F.max("us2").alias("us2"),
        F.max("id1").alias("id1"),
        F.max("id2").alias("id2"),
        F.sum("lag").alias("lag_sum"),
    )
    asked = F.when(F.col("offset").isNotNull(), F.col("end_offset"))
    answered = F.col("end_offset").isNotNull()
    arrivals = (
        paired.groupBy("pair", "topic", "partition")
        .agg(
            F.max(first(asked)).alias("e1"),
            F.max(second(asked)).alias("e2"),
            F.max(first(answered)).alias("seen1"),
            F.max(second(answered)).alias("seen2"),
        )
        .groupBy("pair", "topic")
        .agg(
            F.coalesce(F.sum("e1"), F.lit(0)).alias("ends1"),
            F.coalesce(F.sum("e2"), F.lit(0)).alias("ends2"),
            F.max("seen1").alias("seen1"),
            F.max("seen2").alias("seen2"),
        )
    )
    seconds = (F.col("us2") - F.col("us1")) / F.lit(1e6)
    consumed = F.col("sum2") - F.col("sum1")
    both = F.coalesce(F.col("seen1") & F.col("seen2"), F.lit(False))
    arrived = F.when(both, F.col("ends2") - F.col("ends1")).otherwise(0)
    groups = groups.filter("us1 is not null and us2 is not null and us1 <> us2")
    return (
        _dealt(groups, shares)
        .join(_repeated(arrivals, shares), ["pair", "topic", "share"])
        .select(
            F.col("id2").alias("snapshot_id"),
            F.col("id1").alias("prev_snapshot_id"),
            "group_id",
            "topic",
            seconds.alias("time_delta"),
            consumed.alias("events_consumed"),
            (consumed / seconds).alias("consumption_rate"),
            (arrived / seconds).alias("arrival_rate"),
            "lag_sum",
        )
        .withColumn(
            "remaining_sec",
            eta_seconds(
                F.col("lag_sum"), F.col("consumption_rate"), F.col("arrival_rate"), eta_method
            ),
        )
        .withColumn(
            "remaining_hms",
            F.when(F.col("lag_sum").isNotNull(), hms(F.col("remaining_sec"))).otherwise("-"),
        )
    )
