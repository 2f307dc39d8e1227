"""Group states, filters, and the one place where the filtered inputs are put together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators import ordering
from tidemark.options import Options
from tidemark.session import broadcast_by_count, broadcast_if_small, fixed
from tidemark.sources.snapshots import snapshot_index
from tidemark.sources.tables import (
    LagTables,
    committed_scan,
    end_offset_scan,
    group_scan,
)

# (snapshot, topic) pairs: about 20 MB as a hash table with names of usual length.
BROADCAST_TOPICS = 200_000
# (snapshot, group) pairs: about the same.
BROADCAST_GROUPS = 200_000
# Some 150 MB with the sort's own array.
ROWS_A_TASK = 1_000_000


def group_state() -> Column:
    """Raw state -> one of six. A group that could not be described counts as STABLE; an
    unknown word counts as STABLE while the group has members, else as EMPTY."""
    known = {
        "Stable": S.STABLE,
        "Empty": S.EMPTY,
        "PreparingRebalance": S.PREPARING_REBALANCE,
        "CompletingRebalance": S.COMPLETING_REBALANCE,
        "Dead": S.DEAD,
    }
    state = F.when(F.col("describe_failed"), S.STABLE)
    for raw, name in known.items():
        state = state.when(F.col("raw_state") == raw, name)
    return state.when(F.coalesce("member_count", F.lit(0)) == 0, S.EMPTY).otherwise(S.STABLE)


def with_state(groups: DataFrame) -> DataFrame:
    return group_scan(groups).withColumn("state", group_state())


def _visible(groups: DataFrame, options: Options) -> DataFrame:
    """Rows of the groups an analysis looks at; a group listed twice is still there twice."""
    kept = match_groups(groups, options).withColumn("state", group_state())
    return kept if options.show_empty else kept.filter(F.col("state") != S.EMPTY)


def match_groups(df: DataFrame, options: Options) -> DataFrame:
    """Include, then exclude; both search anywhere in the group id."""
    if options.include:
        df = df.filter(F.col("group_id").rlike(options.include))
    if options.exclude:
        df = df.filter(~F.col("group_id").rlike(options.exclude))
    return df


def is_live() -> Column:
    """True for rows whose group is not EMPTY, where a row carries its group's state columns."""
    return group_state() != S.EMPTY


def live_groups(groups: DataFrame, options: Options) -> DataFrame:
    """The groups an analysis looks at, with their state."""
    return group_scan(_visible(groups, options))


@dataclass(frozen=True)
class Prepared:
    """Inputs after all filters that come before the analysis.

    committed      snapshot_id, group_id, topic, partition, committed_offset (NULL = none)
    topic_offsets  as given; end offsets are read through the properties
    snapshots      snapshot_id, snapshot_seq, captured_us
    given          the offsets before the filters, to be counted
    """

    committed: DataFrame
    topic_offsets: DataFrame
    snapshots: DataFrame
    groups: DataFrame | None
    options: Options
    given: DataFrame | None = None

    @property
    def end_offsets(self) -> DataFrame:
        """End offsets of the partitions without an error."""
        return end_offset_scan(self.topic_offsets)

    @property
    def answers(self) -> DataFrame:
        """The same with the partitions in error, whose offset is NULL."""
        offset = F.when(F.col("error").isNull(), F.col("end_offset")).alias("end_offset")
        return self.topic_offsets.select(*S.PARTITION_KEY, offset)

    @property
    def offsets(self) -> DataFrame:
        """Committed offsets proper, without the topic-only rows."""
        return self.committed.filter(F.col("committed_offset").isNotNull())

    @property
    def asked(self) -> DataFrame:
        """The partitions whose end offsets are looked at, once per group that has them.
        Group filters shrink this set, and with it a topic's arrival rate."""
        if self.options.legacy:
            # The first-generation tool asks for the partitions of one group per topic,
            # the first in group order.
            first = self.committed.groupBy("snapshot_id", "topic").agg(
                F.min("group_id").alias("group_id")
            )
            return self.committed.join(first, S.STATS_KEY, "left_semi").select(*S.PARTITION_KEY)
        return self.offsets.select(*S.PARTITION_KEY)

    @property
    def requested(self) -> DataFrame:
        return self.asked.distinct()

    def is_narrow(self, at_most: int | None = None) -> bool:
        """Whether every topic is known to have at most so many partitions, CHUNK by default:
        partition ids count from 0, so their maximum tells. One narrow column is read."""
        top = self.end_offsets.agg(F.max("partition")).first()[0]
        return top is None or top < (ordering.CHUNK if at_most is None else at_most)

    def tasks(self) -> int:
        """Partitions for a shuffle of the offsets, so that a task sorts some ROWS_A_TASK rows.
        Spark merges partitions by their compressed bytes, and offsets shrink to a tenth or less.
        Stored tables are counted from their footers."""
        rows = (self.committed if self.given is None else self.given).count()
        return max(self.committed.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))

    def wide_topics(self) -> DataFrame:
        """Topics that may have more than CHUNK partitions, per snapshot. Each has at least
        one partition id of CHUNK or above."""
        wide = self.end_offsets.filter(F.col("partition") >= ordering.CHUNK)
        listed = fixed(wide.select("snapshot_id", "topic").distinct())
        return broadcast_if_small(listed, BROADCAST_TOPICS)


def prepare(tables: LagTables, options: Options = Options()) -> Prepared:
    """Apply the group filters once, before anything is joined or counted."""
    if options.legacy:
        committed = tables.group_offsets.filter(F.col("error").isNull())
    else:
        committed = committed_scan(tables.group_offsets)
    committed = match_groups(committed, options).select(
        *S.STATS_KEY, "partition", "committed_offset"
    )
    groups = None
    if tables.groups is not None:
        keys = ["snapshot_id", "group_id"]
        groups = live_groups(tables.groups, options)
        # Listing a group twice does no harm here, so no shuffle to make it unique.
        visible = _visible(tables.groups, options).select(*keys)
        if visible.count() <= BROADCAST_GROUPS:
            visible = F.broadcast(visible)
        else:
            # Of very many groups, often few have offsets: the rows shrink to them before the shuffle.
            groups, own = groups.hint("merge"), committed.select(*keys).distinct()
            held = fixed(own.join(visible.hint("merge"), keys, "left_semi"))
            visible = broadcast_by_count(held, BROADCAST_GROUPS)
        committed = committed.join(visible, keys, "left_semi")
    return Prepared(
        committed=committed,
        topic_offsets=tables.topic_offsets,
        snapshots=snapshot_index(tables),
        groups=groups,
        options=options,
        given=tables.group_offsets,
    )


def topic_groups(prepared: Prepared) -> DataFrame:
    """Which group has which topic: one row each, not a list per topic."""
    return prepared.committed.select(*S.STATS_KEY).distinct()


def topic_usage(prepared: Prepared) -> DataFrame:
    """Per topic: how many groups have it, how many partitions they cover together.

    The members themselves are `topic_groups` and `Prepared.requested`, as rows, so that
    a topic that every group reads does not become one huge list.
    """
    partitions = prepared.requested.groupBy("snapshot_id", "topic").agg(
        F.count("*").alias("n_partitions")
    )
    groups = (
        topic_groups(prepared)
        .groupBy("snapshot_id", "topic")
        .agg(F.count("*").alias("n_groups"))
    )
    return groups.join(partitions, ["snapshot_id", "topic"], "left").select(
        "snapshot_id",
        "topic",
        "n_groups",
        F.coalesce("n_partitions", F.lit(0)).alias("n_partitions"),
    )


def error_rows(tables: LagTables) -> DataFrame:
    """What the scans leave out, for those who want to see it; group_id is NULL for end
    offsets."""
    columns = ["group_id", "topic", "partition", "error"]
    failed = [
        df.filter(F.col("error").isNotNull()).select("snapshot_id", F.lit(kind).alias("kind"), *columns)
        for kind, df in (
            ("topic", tables.topic_offsets.withColumn("group_id", F.lit(None).cast("string"))),
            ("group", tables.group_offsets),
        )
    ]
    return failed[0].unionByName(failed[1])
