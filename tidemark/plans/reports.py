"""What a user asks for: report, status, summary, partition detail, topic info."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import health, text
from tidemark.operators.clean import Prepared, topic_usage
from tidemark.operators.lag import lag_stats
from tidemark.operators.ranks import Ranking
from tidemark.operators.rates import partition_history, rates
from tidemark.options import Options, check_pattern
from tidemark.sources.tables import config_maps, topic_scan

# Sort key -> (column, descending by default).
SORT_KEYS = {
    "group": ("group_id", False),
    "topic": ("topic", False),
    "partitions": ("parts", False),
    "eta": ("remaining_sec", True),
    "lag": ("lag", True),
    "rate": ("consumption_rate", False),
    "newrate": ("new_rate", False),
    "par": ("par", True),
    "cv": ("cv", True),
}
# Partitions of a topic that one task sorts: some 150 MB, spilled where memory is short.
TOPIC_ROWS = 1 << 20
DETAIL_KEYS = {
    "partition": None,
    "lag": "lag",
    "groupoffset": "committed_offset",
    "topicoffset": "end_offset",
    "rate": "rate",
}


def report(prepared: Prepared) -> DataFrame:
    """The main table: one row per pair, group and topic that has a lag."""
    options = prepared.options
    lag, eta = F.col("lag_sum"), F.col("remaining_sec")
    used, arriving = F.col("consumption_rate"), F.col("arrival_rate")
    issue = health.has_issues(eta, lag, arriving)
    if options.legacy:
        issue = health.eta_status(eta)["status"] != "OK"
    rows = rates(prepared).filter("n_parts is not null").select(
        "snapshot_id",
        "prev_snapshot_id",
        "group_id",
        "topic",
        F.col("n_parts").alias("parts"),
        F.col("time_delta").alias("since"),
        F.col("events_consumed").alias("consumed"),
        arriving.cast("bigint").alias("new_rate"),
        used.cast("bigint").alias("cons_rate"),
        used,
        arriving,
        F.col("remaining_hms").alias("eta"),
        eta,
        lag.alias("lag"),
        "par",
        "cv",
        issue.alias("has_issues"),
        health.eta_level(eta).alias("eta_level"),
        health.rate_level(lag, used, arriving).alias("rate_level"),
        health.lag_level().alias("lag_level"),
        health.cv_level(F.col("cv")).alias("cv_level"),
    )
    return finish_report(rows, options)


def finish_report(rows: DataFrame, options: Options) -> DataFrame:
    """The choices that apply to finished rows: they hide rows and change no number."""
    if options.only_issues:
        rows = rows.filter("has_issues")
    if options.group_filter:
        rows = rows.filter(F.col("group_id").rlike(options.group_filter))
    if options.topic_filter:
        rows = rows.filter(F.col("topic").rlike(options.topic_filter))
    group, topic = F.col("group_id"), F.col("topic")
    if options.anonymize:
        group, topic = text.anonymous("group", group), text.anonymous("topic", topic)
    return rows.withColumn("shown_group", group).withColumn("shown_topic", topic)


def filter_report(
    rows: DataFrame, group_pattern: str | None = None, topic_pattern: str | None = None
) -> DataFrame:
    """Filter finished rows again. A bad pattern is an error, not an empty result."""
    for column, pattern in (("group_id", group_pattern), ("topic", topic_pattern)):
        if check_pattern(pattern):
            rows = rows.filter(F.col(column).rlike(pattern))
    return rows


def sort_columns(key: str | None = None, reverse: bool | None = None) -> list[Column]:
    """Sort order of a report. Ties go by group and topic, and reversing reverses all."""
    names, down = sort_names(key, reverse)
    return [F.col(n).desc() if down else F.col(n).asc() for n in names]


def sort_names(key: str | None = None, reverse: bool | None = None) -> tuple[list[str], bool]:
    """The columns of the sort order, and whether all of them descend."""
    column, down = SORT_KEYS[key] if key else ("group_id", False)
    down = down if reverse is None or not key else reverse
    names = list(dict.fromkeys([column, "group_id", "topic"]))
    return ["topic", "group_id"] if column == "topic" else names, down


def legacy_sort_columns(key: str, reverse: bool | None = None) -> list[Column]:
    """The first-generation order: rows without an ETA count as infinitely far, and only
    the ETA is descending by default. It had no ties; ours go by group and topic."""
    column = SORT_KEYS[key][0]
    down = key == "eta" if reverse is None else reverse
    value = F.col(column)
    if key == "eta":
        value = F.when(F.col("eta") == "-", F.lit(float("inf"))).otherwise(value)
    return [value.desc() if down else value.asc(), F.col("group_id"), F.col("topic")]


def sort_report(rows: DataFrame, key: str | None = None, reverse: bool | None = None):
    return rows.orderBy(*sort_columns(key, reverse))


def ranking(rows: DataFrame, key: str | None = None, reverse: bool | None = None) -> Ranking:
    """The index that positions, pages and searches of one sort order share. Nothing runs until
    one of them is asked for; keep `ranking(...).stored(folder)` for many questions. Rows that tie
    go by snapshot, the first one first."""
    names, down = sort_names(key, reverse)
    snapshot = F.bitwise_not("snapshot_id") if down else F.col("snapshot_id")
    return Ranking.of(rows.withColumn("_snapshot", snapshot), [*names, "_snapshot"], down, ["snapshot_id"])


def _ranked(rows: DataFrame | Ranking, key: str | None, reverse: bool | None) -> Ranking:
    return rows if isinstance(rows, Ranking) else ranking(rows, key, reverse)


def number_report(
    rows: DataFrame | Ranking, key: str | None = None, reverse: bool | None = None
) -> DataFrame:
    """Add `position`, from 1 per snapshot, in the sort order. Given a ranking, in its order."""
    return _ranked(rows, key, reverse).positions().drop("_snapshot")


def search_report(
    rows: DataFrame | Ranking, needle: str, key: str | None = None, reverse: bool | None = None
) -> DataFrame:
    """Rows whose shown "group topic" contains the text, in any case, with their place
    `match_index` (from 0) in the sorted report of their snapshot."""
    found = number_report(rows, key, reverse).withColumn("match_index", F.col("position") - 1)
    found = found.drop("position")
    if not needle:  # no search is on: no match
        return found.filter("false")
    shown = F.lower(F.concat_ws(" ", "shown_group", "shown_topic"))
    return found.filter(shown.contains(needle.lower()))


def page(
    rows: DataFrame | Ranking,
    offset: int,
    size: int,
    key: str | None = None,
    reverse: bool | None = None,
) -> DataFrame:
    """Rows offset .. offset+size-1 of the sorted report. An offset beyond the end shows
    the last row. first_row, last_row, n_rows and percent describe the window. In a report
    of several snapshots, rows that tie go by snapshot.

    Counts per range of the order tell which ranges the page touches; only their rows are sorted, so
    a deep page costs what a first one does.
    """
    total = F.col("total")
    first = F.greatest(F.lit(0), F.least(F.lit(offset), total - 1))
    last = F.least(first + size, total)
    return (
        _ranked(rows, key, reverse)
        .page(offset, size)
        .withColumn("first_row", (first + 1).cast("bigint"))
        .withColumn("last_row", last.cast("bigint"))
        .withColumn("n_rows", total.cast("bigint"))
        .withColumn("percent", F.least(F.lit(100), (last / total * 100).cast("int")))
        .drop("_snapshot", "position", "total")
    )


def follow(
    rows: DataFrame, key: str | None = None, reverse: bool | None = None
) -> DataFrame:
    """The row with the largest lag of each snapshot, the first in the sort order if
    several have it. A mergeable arg-max; nothing is sorted or numbered."""
    column, down = SORT_KEYS[key] if key else ("group_id", False)
    down = down if reverse is None or not key else reverse
    ties = ["topic", "group_id"] if column == "topic" else [column, "group_id", "topic"]
    whole = F.struct(*rows.columns)
    if down:
        best = F.max_by(whole, F.struct("lag", *ties))
    else:
        best = F.min_by(whole, F.struct((-F.col("lag")).alias("less"), *ties))
    return rows.groupBy("snapshot_id").agg(best.alias("row")).select("row.*")


def totals(rows: DataFrame) -> DataFrame:
    """Distinct groups and distinct (group, topic) of each snapshot's report."""
    pairs = rows.select("snapshot_id", "group_id", "topic").distinct()
    groups = (
        pairs.groupBy("snapshot_id", "group_id")
        .agg(F.count("*").alias("n"))
        .groupBy("snapshot_id")
        .agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_topics"))
    )
    return groups


def shown_report(rows: DataFrame, plain: bool = False) -> DataFrame:
    """The report as text columns."""
    return rows.select(
        "snapshot_id",
        "shown_group",
        "shown_topic",
        F.col("parts").cast("string").alias("parts"),
        text.decimals(F.col("since"), 1).alias("since"),
        text.si_integer(F.col("consumed"), plain).alias("consumed"),
        text.si_integer(F.col("new_rate"), plain).alias("new_rate"),
        text.si_integer(F.col("cons_rate"), plain).alias("cons_rate"),
        "eta",
        text.si_integer(F.col("lag"), plain).alias("lag"),
        text.ratio_text(F.col("par")).alias("par"),
        text.ratio_text(F.col("cv")).alias("cv"),
    )


def status(prepared: Prepared) -> DataFrame:
    """Health of every rate row. A row without a lag is judged with a lag of 0.

    status_key is the plain "group-topic" text. Two pairs can share it ("a-b"+"c" and
    "a"+"b-c"); here both keep their row.
    """
    legacy = prepared.options.legacy
    lag, eta = F.col("lag_sum"), F.col("remaining_sec")
    used, arriving = F.col("consumption_rate"), F.col("arrival_rate")
    return rates(prepared).select(
        "snapshot_id",
        "group_id",
        "topic",
        F.concat_ws("-", "group_id", "topic").alias("status_key"),
        health.eta_status(eta).alias("eta"),
        health.rate_status(lag, used, arriving, legacy).alias("rate"),
        health.lag_status().alias("lag"),
    )


def summary(prepared: Prepared, topic_configs: DataFrame | None = None) -> DataFrame:
    """Per group and topic: state, partitions, extremes, skew, and the topic's settings.
    A group that has a topic but no lag anywhere keeps one row with a NULL topic."""
    if prepared.groups is None:
        raise ValueError("the summary needs the groups table")
    keys = ["snapshot_id", "group_id"]
    stats = lag_stats(prepared, median=False).select(
        *S.STATS_KEY,
        F.col("n_parts").alias("partitions"),
        "lag_max",
        "lag_min",
        "par",
        "cv",
    )
    if topic_configs is not None:
        stats = stats.join(config_maps(topic_configs), "topic", "left")
    else:
        stats = stats.withColumn("configs", F.lit(None).cast("map<string,string>"))
    return (
        prepared.committed.select(*keys)
        .distinct()
        .join(prepared.groups.select(*keys, "state"), keys)
        .join(stats, keys, "left")
        .select(
            *keys, "state", "topic", "partitions", "lag_max", "lag_min", "par", "cv", "configs"
        )
    )


def lag_table(prepared: Prepared) -> DataFrame:
    """Lag per group and topic with the group's state."""
    if prepared.groups is None:
        raise ValueError("the lag table needs the groups table")
    keys = ["snapshot_id", "group_id"]
    return (
        lag_stats(prepared)
        .join(prepared.groups.select(*keys, "state"), keys)
        .select(
            *S.STATS_KEY,
            F.col("n_parts").alias("partitions"),
            "state",
            "lag_min",
            "lag_max",
            "lag_median",
        )
    )


def rate_table(prepared: Prepared) -> DataFrame:
    """Consumption of each pair of snapshots."""
    return rates(prepared).select(
        *S.STATS_KEY,
        "events_consumed",
        "time_delta",
        "consumption_rate",
        "arrival_rate",
        "remaining_hms",
    )


def summary_table(prepared: Prepared, topic_partitions: DataFrame | None = None) -> DataFrame:
    """Covered/total partitions, median lag and state. The total is what the kept groups
    cover together, or the topic's partition count if its metadata is given."""
    table = lag_table(prepared)
    if topic_partitions is None:
        total = topic_usage(prepared).select("snapshot_id", "topic", "n_partitions")
    else:
        total = topic_info(topic_partitions).select(
            "snapshot_id", "topic", F.col("partitions").alias("n_partitions")
        )
    table = table.join(total, ["snapshot_id", "topic"], "left")
    group, topic = F.col("group_id"), F.col("topic")
    if prepared.options.anonymize:
        group, topic = text.anonymous("group", group), text.anonymous("topic", topic)
    known = F.coalesce("n_partitions", "partitions")
    return table.select(
        *S.STATS_KEY,
        group.alias("shown_group"),
        topic.alias("shown_topic"),
        text.of_total(F.col("partitions"), known).alias("partitions"),
        "lag_median",
        F.concat(F.lit("ConsumerGroupState."), "state").alias("state"),
        health.state_level(F.col("state")).alias("state_level"),
    )


def detail_header(
    prepared: Prepared,
    topic_partitions: DataFrame | None = None,
    topic_configs: DataFrame | None = None,
) -> DataFrame:
    """What stands above the partitions of a group and topic: lag in all, its extremes and
    skew, rates, ETA, and the topic's replication factor and settings."""
    rows = rates(prepared)
    if topic_partitions is not None:
        copies = topic_info(topic_partitions)
        rows = rows.join(
            copies.select("snapshot_id", "topic", "replication_factor"),
            ["snapshot_id", "topic"],
            "left",
        )
    else:
        rows = rows.withColumn("replication_factor", F.lit(None).cast("int"))
    if topic_configs is not None:
        rows = rows.join(config_maps(topic_configs), "topic", "left")
    else:
        rows = rows.withColumn("configs", F.lit(None).cast("map<string,string>"))
    named = finish_report(rows, replace(prepared.options, only_issues=False))
    return named.select(
        *S.STATS_KEY,
        "shown_group",
        "shown_topic",
        F.col("n_parts").alias("partitions"),
        "lag_sum",
        "lag_min",
        "lag_max",
        "par",
        "cv",
        "consumption_rate",
        "arrival_rate",
        "remaining_sec",
        "remaining_hms",
        "replication_factor",
        "configs",
    )


def shown_detail(detail: DataFrame, options: Options = Options()) -> DataFrame:
    """The partitions of `partition_detail` as text columns, names anonymised if asked for."""
    named = finish_report(detail, replace(options, only_issues=False))
    return named.select(
        "snapshot_id",
        "shown_group",
        "shown_topic",
        F.col("partition").cast("string").alias("partition"),
        text.si_integer(F.col("committed_offset")).alias("committed_offset"),
        text.si_integer(F.col("end_offset")).alias("end_offset"),
        text.si_integer(F.col("lag")).alias("lag"),
        text.si_rate(F.col("rate")).alias("rate"),
        "replicas",
        "isr",
        "leader",
        "lag_rank",
        "rate_rank",
    )


def partition_detail(
    prepared: Prepared, topic_partitions: DataFrame | None = None
) -> DataFrame:
    """Offsets, lag, rate, rank within the topic and placement of every partition with a
    lag.

    The rank needs the range of lag and rate over the topic. Topics of at most CHUNK
    partitions lie together already, so a window adds no shuffle; up to TOPIC_ROWS it takes one;
    beyond, the range is a mergeable aggregate that is joined back.
    """
    ranges = [("lag_low", "lag", F.min), ("lag_high", "lag", F.max)]
    ranges += [("rate_low", "rate", F.min), ("rate_high", "rate", F.max)]
    # Placement as it is shown: short text rides along with the rows, lists would not.
    shown = [text.id_list(F.col("replicas")).alias("replicas"), text.id_list(F.col("isr")).alias("isr")]
    leader = F.coalesce(F.col("leader").cast("string"), F.lit("-")).alias("leader")
    more = None
    if topic_partitions is not None:
        placed = topic_scan(topic_partitions).filter(F.col("partition_error").isNull())
        more = placed.select(*S.PARTITION_KEY, *shown, leader)
    narrow = prepared.is_narrow()
    if narrow or prepared.is_narrow(TOPIC_ROWS):
        rows = partition_history(prepared, placed=narrow, more=more)
        topic = Window.partitionBy(*(["block", "chunk"] if narrow else []), *S.STATS_KEY)
        for name, column, edge in ranges:
            rows = rows.withColumn(name, edge(column).over(topic))
    else:
        # Both sides of the join read the same shuffled rows; placement comes behind it.
        rows = partition_history(prepared)
        edges = [edge(column).alias(name) for name, column, edge in ranges]
        rows = rows.join(rows.groupBy(*S.STATS_KEY).agg(*edges), S.STATS_KEY)
        rows = rows if more is None else rows.join(more, S.JOIN_KEY, "left")
    # A partition without placement shows "-".
    known = [F.coalesce(c, F.lit("-")) if more is not None else F.lit("-") for c in ("replicas", "isr", "leader")]
    lag, rate = F.col("lag"), F.col("rate")
    return rows.select(
        *S.STATS_KEY,
        "partition",
        "committed_offset",
        "end_offset",
        lag,
        rate,
        health.rank_bucket(lag, F.col("lag_low"), F.col("lag_high")).alias("lag_rank"),
        health.rank_bucket(rate, F.col("rate_low"), F.col("rate_high")).alias("rate_rank"),
        *[c.alias(n) for c, n in zip(known, ("replicas", "isr", "leader"))],
    )


def number_detail(rows: DataFrame, key: str = "partition", whole: bool = False) -> DataFrame:
    """Position (from 1) of each partition within its group and topic: by partition, or by
    the largest lag, offset or rate first.

    whole: every topic is known to have at most TOPIC_ROWS partitions (`Prepared.is_narrow`). Then
    a task sorts the topics of its groups as they are: one pass and one shuffle, which further
    orders share. Otherwise the order is cut into ranges, whatever the width of a topic.
    """
    column = DETAIL_KEYS[key]
    by = F.coalesce(column, F.lit(0)) if column else F.lit(0)
    # Largest first, as an ascending key; a bigint has no negative of its least value.
    by = -by if column and dict(rows.dtypes)[column] == "double" else F.bitwise_not(by)
    if whole:
        topic = Window.partitionBy(*S.STATS_KEY).orderBy("_by", "partition")
        place = F.row_number().over(topic).cast("bigint")
        return rows.withColumn("_by", by).withColumn("position", place).drop("_by")
    # The keys of a topic come first, so that it lies in few ranges of the order.
    order = [*S.STATS_KEY, "_by", "partition"]
    return Ranking.of(rows.withColumn("_by", by), order, within=S.STATS_KEY).positions().drop("_by")


def topic_info(topic_partitions: DataFrame) -> DataFrame:
    """Topics with their partition count, id and replication factor (that of the lowest
    partition). A topic whose partitions are all in error stays, with 0 partitions."""
    healthy = F.col("partition_error").isNull()
    return (
        topic_scan(topic_partitions)
        .groupBy("snapshot_id", "topic")
        .agg(
            F.count(F.when(healthy, 1)).alias("partitions"),
            F.max("topic_id").alias("topic_id"),
            F.min_by(F.size("replicas"), F.when(healthy, F.col("partition"))).alias(
                "replication_factor"
            ),
        )
    )


def topic_metadata(
    topic_partitions: DataFrame, topic: str, topic_configs: DataFrame | None = None
) -> DataFrame:
    """One topic's row of `topic_info` with its settings; an unknown topic is an error."""
    rows = topic_info(topic_partitions.filter(F.col("topic") == topic))
    if rows.isEmpty():
        raise LookupError(f"topic {topic} not found")
    if topic_configs is None:
        return rows.withColumn("configs", F.lit(None).cast("map<string,string>"))
    return rows.join(config_maps(topic_configs), "topic", "left")


def topic_info_parts(topic_partitions: DataFrame) -> DataFrame:
    """Healthy partitions with leader, replicas, in-sync replicas and their number."""
    return (
        topic_scan(topic_partitions)
        .filter(F.col("partition_error").isNull())
        .select(
            *S.PARTITION_KEY, "leader", "replicas", "isr", F.size("isr").alias("nisrs")
        )
    )
