"""The list of polls: which snapshots exist, in which order, taken when."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_sequence
from tidemark.session import fixed
from tidemark.sources.tables import LagTables

# Three bigints per poll: about 60 MB as a hash table. Beyond it, joins shuffle.
BROADCAST_POLLS = 1_000_000


def snapshot_index(tables: LagTables) -> DataFrame:
    """(snapshot_id, snapshot_seq, captured_us), one row per poll.

    Every table counts, not only committed offsets: a poll that saw no group still
    separates its neighbours. The time of a poll is the last group-offset time in it, and
    filters on groups never change the list. A derived list is computed once and kept.

    Numbers count from the first poll that the analysis covers, plus `tables.since`; so a
    slice of a history pairs and counts like a history of its own, with or without a list.
    """
    given = tables.snapshots
    derived = given is None or "snapshot_seq" not in given.columns
    if given is None:
        listed = [tables.group_offsets.select("snapshot_id", "captured_at")]
        for other in (tables.topic_offsets, tables.groups):
            if other is not None:
                listed.append(
                    other.select(
                        "snapshot_id", F.lit(None).cast("timestamp").alias("captured_at")
                    )
                )
        given = (
            reduce(DataFrame.unionByName, listed)
            .groupBy("snapshot_id")
            .agg(F.max("captured_at").alias("captured_at"))
        )
    if "snapshot_seq" not in given.columns:
        given = dense_sequence(given, "snapshot_id", "snapshot_seq")
    index = given.select(
        "snapshot_id",
        F.col("snapshot_seq").cast("bigint").alias("snapshot_seq"),
        F.unix_micros("captured_at").alias("captured_us"),
    )
    if derived:
        index = fixed(index)
    n, first = index.agg(F.count("*"), F.min("snapshot_seq")).first()
    index = index.withColumn("snapshot_seq", F.col("snapshot_seq") - (first or 0) + tables.since)
    return F.broadcast(index) if n <= BROADCAST_POLLS else index
