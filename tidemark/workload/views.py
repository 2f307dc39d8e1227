"""Snapshot tables derived from an `events` table, for the registered queries.

An event is a record of the topic named by its type; the user is the partition, so the
number of partitions grows with the data. Topic "error" is skewed: most of its records go
to partition 0. Nine consumer groups follow the log at different speeds; their committed
offsets are counts of real records, up to the hour each group has reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.session import shared_dir, small_tasks
from tidemark.sources.layout import load_bucketed, store_bucketed
from tidemark.sources.logs import (
    READ_COMMITTED,
    committed_offsets_from_log,
    end_offsets_from_log,
)
from tidemark.sources.snapshots import snapshot_index
from tidemark.sources.tables import LagTables, group_scan, read_table
from tidemark.streaming.closed import closing_row

EPOCH_US = 1704067200000000  # 2024-01-01, the first day of the events
HOUR_US = 3600000000

# Spread of the records over partitions in the wide form: 5,000 partitions of one topic.
WIDE = "case when event_type = 'click' then event_id * 7919 % 5000 else user_id % 8 end"

# How far each group has read at snapshot s, in hours since the first day.
HORIZONS = {
    "g-realtime": "24*s",
    "g-steady": "24*s-6",
    "g-slow": "8*s",
    "g-stalled": "least(24*s,216)",
    "g-catchup": "case when s<14 then least(24*s,96) else least(24*s,96+40*(s-14)) end",
    "g-partial": "24*s-12",
    "g-ahead": "24*s",
    "g-empty": "least(24*s,48)",
    "g-silent": "24*s",
}
# Which rows of a group exist at all.
PRESENT = """case group_id
    when 'g-steady'  then topic in ('click','view') and snapshot_id<>12
    when 'g-partial' then topic='click' and (partition in (0,1,2,5)
                          or (partition=3 and snapshot_id<14) or (partition=6 and snapshot_id>=19))
    when 'g-ahead'   then topic='signup'
    when 'g-empty'   then topic='purchase'
    when 'g-silent'  then topic='view'
    else true end"""
# (group, raw state, members, describe failed); g-slow is listed twice.
GROUPS = [
    ("g-realtime", "Stable", 3, False),
    ("g-steady", "Stable", 2, False),
    ("g-slow", "Stable", 1, False),
    ("g-slow", "Stable", 1, False),
    ("g-stalled", "Assigning", 1, False),
    ("g-catchup", "PreparingRebalance", 2, False),
    ("g-partial", "CompletingRebalance", 2, False),
    ("g-ahead", "Empty", 0, True),
    ("g-empty", "Empty", 0, False),
    ("g-silent", "Dead", 0, False),
    ("g-ghost", "", 0, False),
]
# Raw states of the groups of conversations; one is unknown.
RAW_STATES = ("Stable", "Empty", "Assigning", "Dead", "PreparingRebalance", "CompletingRebalance")
_GROUP_COLUMNS = ("group_id", "raw_state", "member_count", "describe_failed")
CONFIGS = [
    ("click", "retention.ms", "1209600000"),
    ("click", "x.ms", "5400000"),
    ("click", "flush.ms", "60000"),
    ("click", "segment.bytes", "1073741824"),
    ("click", "secret", ""),
    ("view", "retention.ms", "1209600000"),
    ("view", "flush.ms", "60000"),
]


def _records(events: DataFrame, spread: str) -> DataFrame:
    time = F.col("ts")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        # The times carry no zone and mean UTC, whatever the session's zone.
        time = F.convert_timezone(F.lit("UTC"), F.current_timezone(), time)
    return events.select(
        F.col("event_type").alias("topic"),
        F.expr(
            "cast(case when event_type = 'error' then case when user_id % 10 < 7 then 0 "
            f"else user_id % 4 end else {spread} end as int)"
        ).alias("partition"),
        time.cast("timestamp").alias("timestamp"),
        "event_id",
    )


def _hour(column: str = "timestamp"):
    return F.expr(f"(unix_micros({column}) - {EPOCH_US} + {HOUR_US - 1}) div {HOUR_US}")


def topic_log(records: DataFrame, *more: str) -> DataFrame:
    """Give every record its offset; `more` columns of the records go along. Offsets count up per minute of a partition and start
    from the count of the minutes before, so a busy partition spreads over its minutes."""
    keys = ["topic", "partition"]
    rows = records.withColumn("minute", F.expr("unix_micros(timestamp) div 60000000"))
    before = (
        Window.partitionBy(*keys).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*keys, "minute")
        .agg(F.count("*").alias("n"))
        .select(*keys, "minute", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy(*keys, "minute").orderBy("timestamp", "event_id")
    return rows.join(starts, [*keys, "minute"]).select(
        *keys,
        (F.col("start") + F.row_number().over(within) - 1).alias("offset"),
        "timestamp",
        *more,
    )


def daily_log(records: DataFrame) -> DataFrame:
    """The last record of every partition and day of the topic log. Days end when the daily polls are
    taken, so the end offsets at these polls are those of the whole log; only counts are shuffled."""
    keys = ["topic", "partition"]
    counts = records.groupBy(*keys, F.ceil(_hour() / 24).alias("day")).agg(
        F.count("*").alias("n"), F.max("timestamp").alias("timestamp")
    )
    upto = Window.partitionBy("partition", "topic").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*keys, (F.sum("n").over(upto) - 1).alias("offset"), "timestamp")


def transactional(records: DataFrame) -> DataFrame:
    """A topic log with transactions: of four events in a row three belong to a producer each, and
    every fifth of a producer's events is its marker."""
    log = topic_log(records, "event_id").withColumn("producer_id", F.expr("nullif(event_id % 4, 3)"))
    return log.withColumn("control", F.expr("event_id div 4 % 5 = 0")).drop("event_id")


def daily_snapshots(records: DataFrame) -> DataFrame:
    """One poll at the end of every day that the records reach."""
    days = records.agg(F.ceil(F.max(_hour()) / 24).alias("days"))
    day = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("days")))
    return days.select(day.alias("snapshot_id")).select(
        "snapshot_id",
        F.timestamp_micros(F.col("snapshot_id") * 24 * HOUR_US + EPOCH_US).alias("captured_at"),
    )


def uneven_snapshots(records: DataFrame) -> DataFrame:
    """Polls ever further apart, at the hours 1, 4, 9, 16, ..., and one a year before."""
    squares = F.sequence(F.lit(0), F.floor(F.sqrt(F.max(_hour()))).cast("int"))
    polls = records.agg(squares.cast("array<bigint>").alias("k")).select(
        F.explode("k").alias("snapshot_id")
    )
    hour = F.when(F.col("snapshot_id") == 0, -8760).otherwise(F.expr("snapshot_id * snapshot_id"))
    return polls.withColumn("captured_at", F.timestamp_micros(hour * HOUR_US + EPOCH_US))


def commit_log(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every group's commits: at each snapshot, the count of records it has read by then.
    A group starts with offset 0 when a partition appears."""
    keys = ["topic", "partition"]
    hourly = records.groupBy(*keys, _hour().alias("hour")).agg(F.count("*").alias("n"))
    horizon = F.coalesce(
        *[F.when(F.col("group_id") == g, F.expr(h)) for g, h in HORIZONS.items()]
    ).cast("bigint")
    reach = (
        snapshots.select(F.col("snapshot_id").alias("s"))
        .withColumn("group_id", F.explode(F.array(*[F.lit(g) for g in HORIZONS])))
        .withColumn("h", horizon)
        .withColumn("h0", F.lag("h", 1, -1).over(Window.partitionBy("group_id").orderBy("s")))
        .filter("h > h0")
        .select("group_id", "s", F.explode(F.sequence(F.col("h0") + 1, "h")).alias("hour"))
    )
    # One row per group and hour.
    read = hourly.join(F.broadcast(reach), "hour").select("group_id", *keys, "s", "n")
    opened = (
        hourly.groupBy(*keys)
        .agg(F.greatest(F.ceil(F.min("hour") / 24), F.lit(1)).cast("bigint").alias("s"))
        .withColumn("group_id", F.explode(F.array(*[F.lit(g) for g in HORIZONS])))
        .select("group_id", *keys, "s", F.lit(0).cast("bigint").alias("n"))
    )
    upto = (
        Window.partitionBy("partition", "group_id", "topic")
        .orderBy("s")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        read.unionByName(opened)
        .groupBy("group_id", *keys, "s")
        .agg(F.sum("n").alias("n"))
        .select(
            "group_id",
            *keys,
            F.sum("n").over(upto).alias("offset"),
            F.timestamp_micros(F.col("s") * 24 * HOUR_US + EPOCH_US).alias("commit_ts"),
        )
    )


def group_offsets(log: DataFrame, topic_offsets: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Commits as of each snapshot, with the special groups' peculiarities: some rows do
    not exist, some have nothing committed, one group is ahead of the log, and one poll
    result is an error."""
    rows = committed_offsets_from_log(log, snapshots).filter(F.expr(PRESENT))
    ahead = (
        topic_offsets.filter("partition = 0 and topic = 'signup'")
        .withColumn("group_id", F.lit("g-ahead"))
        .select("snapshot_id", "group_id", "topic", "partition", "end_offset")
    )
    # One row per poll: sent to every task, so that the offsets need no shuffle for it.
    rows = rows.join(F.broadcast(ahead), ["snapshot_id", "group_id", "topic", "partition"], "left")
    none = "group_id = 'g-silent' or (group_id = 'g-partial' and partition = 5)"
    committed = (
        F.when(F.expr(none), -1)
        .when(F.col("end_offset").isNotNull(), F.col("end_offset") + 5)
        .otherwise(F.col("committed_offset"))
    )
    rows = rows.withColumn("committed_offset", committed.cast("bigint")).drop("end_offset")
    answer = lambda group, error: F.struct(group.alias("group_id"), error.alias("error"))
    own = answer(F.col("group_id"), F.col("error"))
    broken = answer(F.lit("g-broken"), F.lit("COORDINATOR_NOT_AVAILABLE"))
    both = F.when(F.expr("group_id = 'g-realtime' and partition = 0"), F.array(own, broken))
    answers = rows.withColumn("_as", F.explode(both.otherwise(F.array(own))))
    return answers.select("snapshot_id", "captured_at", "_as.group_id", "topic", "partition", "committed_offset", "_as.error")


def topic_partitions(topic_offsets: DataFrame) -> DataFrame:
    """Placement on three brokers; a few partitions and one topic in error."""
    p = F.col("partition")
    text = lambda value: F.lit(value).cast("string")
    leader = (p % 3 + 1).cast("int")
    both = F.array(leader, ((p + 1) % 3 + 1).cast("int"))
    rows = topic_offsets.select(
        "snapshot_id",
        "topic",
        F.concat(F.lit("id-"), "topic").alias("topic_id"),
        "partition",
        leader.alias("leader"),
        both.alias("replicas"),
        F.when(p == 7, F.array(leader)).otherwise(both).alias("isr"),
        text(None).alias("topic_error"),
        F.when(p % 50 == 49, text("LEADER_NOT_AVAILABLE")).alias("partition_error"),
    )
    one = rows.filter("topic = 'click' and partition = 0").drop("topic_error", "partition_error")
    ghost = one.withColumn("topic", F.lit("ghost")).withColumn("topic_error", text("UNKNOWN"))
    lost = one.withColumn("topic", F.lit("lost")).withColumn("topic_error", text(None))
    return rows.unionByName(ghost.withColumn("partition_error", text(None))).unionByName(
        lost.withColumn("partition_error", text("LEADER_NOT_AVAILABLE"))
    )


class Views:
    """The derived tables of one folder of test data, as plans."""

    def __init__(self, spark: SparkSession, sf_dir: str, spread: str = "user_id"):
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self.spark = spark
        self.conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
        self.records = _records(events, spread)
        self.snapshots = daily_snapshots(self.records)
        self.index = self.index_of(self.snapshots)

    @staticmethod
    def index_of(snapshots: DataFrame) -> DataFrame:
        return snapshot_index(
            LagTables(group_offsets=None, topic_offsets=None, snapshots=snapshots)
        )

    def uneven_index(self) -> DataFrame:
        return self.index_of(uneven_snapshots(self.records))

    def end_offsets(self, index: DataFrame | None = None) -> DataFrame:
        return end_offsets_from_log(topic_log(self.records), index or self.index)

    def stable_offsets(self) -> DataFrame:
        return end_offsets_from_log(transactional(self.records), self.index, READ_COMMITTED)

    def commits(self) -> DataFrame:
        return commit_log(self.records, self.snapshots)

    def groups(self) -> DataFrame:
        """The groups above at every poll, and one for each conversation from one of the first polls
        on: they read nothing yet, so there are ever more groups without an offset."""
        entry = F.explode(
            F.array(
                *[
                    F.struct(*[F.lit(v).alias(n) for n, v in zip(_GROUP_COLUMNS, row)])
                    for row in GROUPS
                ]
            )
        )
        named = self.snapshots.select("snapshot_id", entry.alias("g")).select("snapshot_id", "g.*")
        last = self.snapshots.agg(F.max("snapshot_id")).first()[0]
        held = self.conversations.filter("conv_id is not null").groupBy("conv_id")
        raw = F.element_at(F.array(*map(F.lit, RAW_STATES)), F.expr("cast(conv_id % 6 as int) + 1"))
        polls = F.sequence(F.expr("conv_id % 5 + 1"), F.lit(last).cast("bigint"))
        of_conversations = held.agg(F.count_distinct("role").alias("roles")).select(
            F.explode(polls).alias("snapshot_id"),
            F.format_string("c-%d", "conv_id").alias("group_id"),
            raw.alias("raw_state"),
            (F.col("roles") - 1).cast("int").alias("member_count"),
            F.expr("conv_id % 17 = 0").alias("describe_failed"),
        )
        return named.unionByName(of_conversations).withColumn("is_simple", F.lit(False))

    def configs(self) -> DataFrame:
        """The settings above, and two for each topic that its records give."""
        fixed_ones = self.spark.createDataFrame(CONFIGS, "topic string, key string, value string")
        span = F.expr("(max(unix_micros(timestamp)) - min(unix_micros(timestamp))) div 1000")
        measured = self.records.groupBy("topic").agg(F.count("*").alias("records"), span.alias("span"))
        setting = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
        found = F.explode(F.array(setting("measured.records", F.col("records")), setting("measured.span.ms", F.col("span"))))
        return fixed_ones.unionByName(measured.select("topic", found.alias("s")).select("topic", "s.*"))

    def brokers(self) -> DataFrame:
        rows = [(i, f"host-{i}", 9092) for i in (1, 2, 3)]
        return self.spark.createDataFrame(rows, "broker_id int, host string, port int")


OFFSETS_AND_GROUPS = ("group_offsets", "topic_offsets", "groups")
DERIVED = (*OFFSETS_AND_GROUPS, "topic_partitions", "topic_configs", "brokers")


class _Stored:
    """The derived tables of one folder of test data, each written when it is first asked for, as a
    poller would leave it: one folder per snapshot, so that a filter on snapshots prunes files."""

    def __init__(self, spark: SparkSession, sf_dir: str, spread: str, folder: str):
        self.spark, self.folder = spark, folder
        self.views = Views(spark, sf_dir, spread)
        self.views.index.write.parquet(f"{folder}/index")
        self.views.index = spark.read.parquet(f"{folder}/index")
        self.written: set[str] = set()

    def index(self) -> DataFrame:
        return self.views.index.withColumn("captured_at", F.timestamp_micros("captured_us"))

    def table(self, name: str) -> DataFrame:
        target = f"{self.folder}/{name}"
        if name not in self.written:
            rows = getattr(self, f"_{name}")()
            if "snapshot_id" in rows.columns and name != "groups":
                # Rebalancing by snapshot keeps files few and splits an oversized snapshot.
                rows.hint("rebalance", "snapshot_id").write.partitionBy("snapshot_id").parquet(target)
            else:
                rows.write.parquet(target)
            self.written.add(name)
        return read_table(self.spark, name, target)

    def _ends(self) -> DataFrame:
        return self.table("topic_offsets").filter("error is null")

    def _topic_offsets(self) -> DataFrame:
        # Every fiftieth partition also answers with an error, under another number.
        failed = F.when(F.col("partition") % 50 == 0, F.array(F.lit(False), F.lit(True)))
        return (
            end_offsets_from_log(daily_log(self.views.records), self.views.index)
            .withColumn("failed", F.explode(failed.otherwise(F.array(F.lit(False)))))
            .withColumn(
                "partition",
                F.when(F.col("failed"), F.col("partition") + 1000000).otherwise(F.col("partition")),
            )
            .withColumn("error", F.when(F.col("failed"), F.lit("LEADER_NOT_AVAILABLE")))
            .drop("failed")
        )

    def _group_offsets(self) -> DataFrame:
        return group_offsets(self.views.commits(), self._ends(), self.views.index)

    def _topic_partitions(self) -> DataFrame:
        return topic_partitions(self._ends())

    def _groups(self) -> DataFrame:
        return self.views.groups()

    def _topic_configs(self) -> DataFrame:
        return self.views.configs()

    def _brokers(self) -> DataFrame:
        return self.views.brokers()


_stored: dict[tuple[str, str, str], _Stored] = {}


def _stored_of(spark: SparkSession, sf_dir: str, spread: str = "user_id") -> _Stored:
    small_tasks(spark)
    key = (spark.sparkContext.applicationId, sf_dir, spread)
    if key not in _stored:
        folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}-{len(_stored)}"
        _stored[key] = _Stored(spark, sf_dir, spread, folder)
    return _stored[key]


def stored_tables(
    spark: SparkSession, sf_dir: str, spread: str = "user_id", only: tuple[str, ...] = DERIVED
) -> LagTables:
    """The derived tables, written once per application to the shared folder, and the list of polls.
    Those not in `only` are None; nothing is derived for them."""
    stored = _stored_of(spark, sf_dir, spread)
    tables = {name: stored.table(name) if name in only else None for name in DERIVED}
    return LagTables(**tables, snapshots=stored.index())


def stored_folder(spark: SparkSession, sf_dir: str) -> str:
    return _stored_of(spark, sf_dir).folder


def bucketed_name(spark: SparkSession, sf_dir: str) -> str:
    """The name of the same offset tables in buckets, written once per application."""
    folder = f"{stored_folder(spark, sf_dir)}/bucketed"
    name = "polls_" + "".join(c if c.isalnum() else "_" for c in folder.split("/")[-2])
    if folder not in _written:
        tables = stored_tables(spark, sf_dir, only=OFFSETS_AND_GROUPS)
        store_bucketed(tables, name, folder, spark.sparkContext.defaultParallelism)
        _written.add(folder)
    return name


def bucketed_tables(spark: SparkSession, sf_dir: str) -> LagTables:
    tables, name = stored_tables(spark, sf_dir, only=("groups",)), bucketed_name(spark, sf_dir)
    return load_bucketed(spark, name, groups=tables.groups, snapshots=tables.snapshots)


# Polls that a replayed stream takes in one micro-batch, in however many files.
POLLS_A_BATCH = 16
_written: set[str] = set()
_files_a_poll: dict[str, int] = {}


def _snapshot_rows(tables: LagTables) -> DataFrame:
    """Committed and end offset and the group's state in one row."""
    ends = tables.topic_offsets.filter("error is null").select(
        "snapshot_id", "topic", "partition", "end_offset"
    )
    states = group_scan(tables.groups).select(
        "snapshot_id", "group_id", "raw_state", "member_count", "describe_failed"
    )
    rows = tables.group_offsets.filter("error is null").drop("error")
    rows = rows.join(states, ["snapshot_id", "group_id"])
    return rows.join(ends, ["snapshot_id", "topic", "partition"], "left")


def _marked(log: DataFrame, time: str, snapshots: DataFrame) -> DataFrame:
    """A log with a mark for every poll: no topic, the poll's time, its id as offset."""
    given = {time: F.col("captured_at"), "offset": F.col("snapshot_id")}
    blank = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema]
    return log.unionByName(snapshots.select(*blank))


def stored_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of one of the tables as a poller leaves it: files in the order of the polls, and a
    closing row behind the last one."""
    folder = f"{stored_folder(spark, sf_dir)}/stream-{name}"
    needed = OFFSETS_AND_GROUPS if name == "snapshot_rows" else (name,)
    tables = stored_tables(spark, sf_dir, only=needed)
    polls, time = tables.snapshots, "captured_at"
    if name == "topic_log":
        views, time = Views(spark, sf_dir), "timestamp"
        rows = _marked(topic_log(views.records), time, polls)
    elif name == "commit_log":
        views, time = Views(spark, sf_dir), "commit_ts"
        rows = _marked(commit_log(views.records, tables.snapshots), time, polls)
    elif name == "snapshot_rows":
        rows = _snapshot_rows(tables)
    else:
        rows = getattr(tables, name)
    if folder not in _written:
        first, last, n = polls.agg(F.min("captured_at"), F.max("captured_at"), F.count("*")).first()
        period = (last - first) / max(1, n - 1)
        closing = closing_row(spark, rows.schema, F.lit(last + 2 * period), time)
        hours = F.expr(f"(unix_micros({time}) - {EPOCH_US} + {24 * HOUR_US - 1}) div {24 * HOUR_US}")
        arrived = F.greatest(hours, F.lit(1)).cast("int")
        sent = rows.unionByName(closing).withColumn("arrived", arrived)
        sent.hint("rebalance", "arrived").write.partitionBy("arrived").parquet(folder)
        _files_a_poll[folder] = _dated_by_poll(spark, folder)
        _written.add(folder)
    schema = StructType([*rows.schema.fields, StructField("arrived", IntegerType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", POLLS_A_BATCH * _files_a_poll[folder])
    return stream.parquet(folder).drop("arrived")


def _dated_by_poll(spark: SparkSession, folder: str) -> int:
    """Files were written at once; a stream reads them by their times, so give them the order in
    which they would have come. The driver sees the names of the files of the polls. Returns the
    files of a poll, on average and rounded up: a large poll has several."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/arrived=*"))
    found = 0
    for part in parts:
        number = int(part.getPath().getName().split("=")[1])
        for file in files.listStatus(part.getPath()):
            files.setTimes(file.getPath(), 1_700_000_000_000 + 1000 * number, -1)
            found += 1
    return -(-found // len(parts))
