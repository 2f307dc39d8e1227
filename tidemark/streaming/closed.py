"""Whole polls on a stream: rows are held until their poll is closed, then released together.

Rows of a poll share a period of time. They are written to the shared folder as they arrive and come
out in one micro-batch, when both streams have passed the end of their period; a row that is delivered
twice counts once, and a row of a poll that has been released is late and dropped. A poll is written
and read in sequence, whatever its size: nothing is kept per key. So any batch operator can follow,
medians of topics of any width included, and its joins and aggregates are planned for the poll at hand.

Records of logs (`streaming.logs`) are held in the same way.

A closing row has nothing but its time: everything before that time has been delivered. It
goes through the same source as the rows, so that it cannot overtake them, and closes the last poll
without data of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.options import Options
from tidemark.sources.tables import LagTables

CONTROL = "version bigint, since timestamp, paused boolean, options string"
PROGRESS = "first bigint, polls bigint"
KINDS = ("group", "topic")
# How far each stream has come, and the last time that a row of the micro-batch is held to.
REACHED = "group_at timestamp, topic_at timestamp, held_to timestamp"


def is_data(time: str = "captured_at", present: str = "snapshot_id") -> Column:
    """False for closing rows. The condition names the time: a filter that does not is moved
    below the watermark, and the closing row would be gone before its time counts."""
    return F.when(F.col(time).isNotNull(), F.col(present).isNotNull())


def data_rows(rows: DataFrame, time: str = "captured_at", present: str = "snapshot_id") -> DataFrame:
    """Watermarked rows without closing rows. Every column depends on the time from here on, so
    that no condition on it, written or inferred from a join, is moved below the watermark."""
    guarded = [F.when(F.col(time).isNotNull(), F.col(c)).alias(c) for c in rows.columns if c != time]
    return rows.filter(is_data(time, present)).select(time, *guarded)


def closing_row(spark: SparkSession, schema: StructType, at: Column, time: str = "captured_at") -> DataFrame:
    """One closing row for a source of this schema."""
    columns = [(at if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(1).select(*columns)


def closed_polls(
    group_offsets: DataFrame, topic_offsets: DataFrame, period: int, delay: str
) -> DataFrame:
    """Both offset streams in one: snapshot_id, captured_at, kind (group or topic), group_id, topic,
    partition, offset, error, and `due`, the time that both streams must have reached for the row's
    poll to be released by `ClosedPolls`. The slower stream holds it back."""

    def one(stream: DataFrame, kind: str, group: Column, offset: str) -> DataFrame:
        end = F.window("captured_at", f"{period} seconds")["end"]
        return stream.select(
            "snapshot_id", "captured_at", F.lit(kind).alias("kind"), group.alias("group_id"), "topic",
            "partition", F.col(offset).alias("offset"), "error",
            (end + F.expr(f"interval {delay}")).alias("due"),
        )

    return one(group_offsets, "group", F.col("group_id"), "committed_offset").unionByName(
        one(topic_offsets, "topic", F.lit(None).cast("string"), "end_offset")
    )


def offset_tables(rows: DataFrame, **more) -> LagTables:
    """Rows of `closed_polls` as the two offset tables."""
    keys = ["topic", "partition"]
    named = lambda kind, more, name: rows.filter(F.col("kind") == kind).select(
        "snapshot_id", "captured_at", *more, *keys, F.col("offset").alias(name), "error"
    )
    return LagTables(
        group_offsets=named("group", ["group_id"], "committed_offset"),
        topic_offsets=named("topic", [], "end_offset"),
        **more,
    )


@dataclass(frozen=True)
class Control:
    """Options of a running stream, kept as versions in a shared folder. Every micro-batch reads
    them; a version holds for the polls taken at `since` or later, until a later version of
    these. So a filter changes without a restart, and a repeated micro-batch sees the same."""

    folder: str

    def change(self, spark: SparkSession, since, options: Options = Options(), paused: bool = False) -> int:
        """Append a version. While paused, polls are not taken: the next pair spans them."""
        number = max((v for v, *_ in self.versions(spark)), default=0) + 1
        row = (number, since, paused, json.dumps(asdict(options)))
        spark.createDataFrame([row], CONTROL).coalesce(1).write.mode("append").parquet(self.folder)
        return number

    def versions(self, spark: SparkSession) -> list[tuple]:
        """(version, since, options, or None while paused): a few rows, written by hand."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = spark.read.schema(CONTROL).parquet(self.folder).collect()
        return sorted(
            (r.version, r.since, None if r.paused else Options(**json.loads(r.options))) for r in rows
        ) if rows else []

    @staticmethod
    def at(versions: list[tuple], time, usual: Options) -> tuple[int, Options | None]:
        """The latest version that holds for a poll taken at `time`."""
        held = [(v, options) for v, since, options in versions if since <= time]
        return max(held, key=lambda h: h[0]) if held else (0, usual)


class Folders:
    """A sink that writes folders named by micro-batch, so that a repeated one replaces its own."""

    folder: str
    # The session the stream was started from. Spark plans a micro-batch's own session without
    # adaptive execution and with the number of state partitions.
    session = None

    def _path(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _ids(self, spark: SparkSession, name: str, before: int) -> list[int]:
        """The micro-batches before this one that have left such a folder, whole."""
        files, path = self._path(spark, f"{name}/*/_SUCCESS")
        found = files.globStatus(path) or []
        return sorted(i for f in found if (i := int(f.getPath().getParent().getName())) < before)

    def _delete(self, spark: SparkSession, name: str) -> None:
        files, path = self._path(spark, name)
        files.delete(path, True)

    def _latest(self, spark: SparkSession, name: str, batch_id: int, schema) -> DataFrame | None:
        """What the last micro-batch before this one left; micro-batches without a closed poll
        leave nothing."""
        ids = self._ids(spark, name, batch_id)
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}/{ids[-1]}") if ids else None

    def _due(self, spark: SparkSession, schema: StructType, batch_id: int, before, until) -> DataFrame:
        """The held rows that became due after `before`, up to `until`."""
        kept = []
        for i in self._ids(spark, "held", batch_id + 1):
            # What was due before this micro-batch has been released, and is not needed to repeat it.
            done = before is not None and i < batch_id and self._all_due(spark, i, before)
            if done:
                self._delete(spark, f"held/{i}")
            else:
                kept.append(f"{self.folder}/held/{i}")
        rows = spark.read.schema(schema).parquet(*kept).filter(F.col("due") <= F.lit(until))
        return rows if before is None else rows.filter(F.col("due") > F.lit(before))

    def _all_due(self, spark: SparkSession, batch_id: int, time) -> bool:
        held_to = spark.read.schema(REACHED).parquet(f"{self.folder}/reached/{batch_id}").first().held_to
        return held_to is None or held_to <= time

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/out").drop("batch_id")

    def run(self, rows: DataFrame, state_partitions: int | None = None, **trigger) -> StreamingQuery:
        """Start on a stream, e.g. run(rows, processingTime="5 seconds"); without a trigger it
        takes what is there and ends. The number of state partitions is fixed at the first start."""
        self.session = rows.sparkSession
        conf, name = self.session.conf, "spark.sql.shuffle.partitions"
        usual = conf.get(name)
        conf.set(name, str(state_partitions or usual))
        try:
            return (
                rows.writeStream.foreachBatch(self)
                .outputMode("append")
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(**(trigger or {"availableNow": True}))
                .start()
            )
        finally:
            conf.set(name, usual)


@dataclass
class ClosedPolls(Folders):
    """
    The sink of a stream of whole polls (`closed_polls`, or rows in that form).

    analyse  batch operator: tables of the released polls and the options -> result rows
    folder   shared folder for results (`out`), rows of open polls (`held`) and of those just released
             (`closed`), the last poll (`carried`), times (`reached`) and counts (`progress`)
    pairs    give each poll the one before it as well, for rates; only then is a poll carried, once
    groups   group states, as a table that the polls' rows are looked up in
    polls    stop after so many polls (`until_done`); None = never
    control  versions of the options

    Folders are named by micro-batch, so a repeated one replaces its own output.
    """

    analyse: Callable[[LagTables, Options], DataFrame]
    folder: str
    pairs: bool = False
    groups: DataFrame | None = None
    polls: int | None = None
    control: Control | None = None
    options: Options = field(default_factory=Options)
    taken: int = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.session or batch.sparkSession
        if "due" not in batch.columns:  # whole polls already
            rows = batch.persist()
            try:
                self._analyse(spark, rows, batch_id)
            finally:
                rows.unpersist()
            return
        rows = self._release(spark, batch, batch_id)
        if rows is not None:
            self._analyse(spark, rows, batch_id)

    def _analyse(self, spark: SparkSession, rows: DataFrame, batch_id: int) -> None:
        # The list of polls in this micro-batch.
        listed = rows.groupBy("snapshot_id").agg(F.max("captured_at").alias("at")).collect()
        if listed:
            self._take(spark, rows, sorted((r.at, r.snapshot_id) for r in listed), batch_id)

    def _release(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Hold the rows that have arrived; the rows of the polls that are closed by now, if any."""
        own = f"{self.folder}/held/{batch_id}"
        batch.write.mode("overwrite").parquet(own)
        fresh = spark.read.schema(batch.schema).parquet(own)
        at = [F.max(F.when(F.col("kind") == k, F.col("captured_at"))).alias(k) for k in KINDS]
        due = F.max(F.when(F.col("snapshot_id").isNotNull(), F.col("due"))).alias("due")
        now = fresh.agg(*at, due).first()
        last = self._latest(spark, "reached", batch_id, REACHED)
        last = tuple(last.first())[:2] if last is not None else (None, None)
        came = [max((t for t in pair if t is not None), default=None) for pair in zip(last, (now.group, now.topic))]
        before, until = (None if None in times else min(times) for times in (last, came))
        rows = None
        if until is not None:
            rows = self._closed(spark, batch.schema, batch_id, before, until)
        reached = spark.createDataFrame([(*came, now.due)], REACHED).coalesce(1)
        reached.write.mode("overwrite").parquet(f"{self.folder}/reached/{batch_id}")
        return rows

    def _closed(self, spark: SparkSession, schema: StructType, batch_id: int, before, until) -> DataFrame | None:
        rows = self._due(spark, schema, batch_id, before, until).filter("snapshot_id is not null")
        if rows.isEmpty():
            return None
        for i in self._ids(spark, "closed", batch_id):
            self._delete(spark, f"closed/{i}")
        # Written once per poll: an analysis may read them any number of times.
        target = f"{self.folder}/closed/{batch_id}"
        keys, values = ["partition", "snapshot_id", "kind", "group_id", "topic"], ["offset", "error", "captured_at"]
        once = rows.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])
        once.write.mode("overwrite").parquet(target)
        return spark.read.schema(once.schema).parquet(target)

    def _take(self, spark: SparkSession, rows: DataFrame, listed: list[tuple], batch_id: int) -> None:
        last = self._latest(spark, "progress", batch_id, PROGRESS)
        first, n = last.first() if last is not None else (0, 0)
        first += n
        versions = self.control.versions(spark) if self.control else []
        dated = [(Control.at(versions, at, self.options), at, s) for at, s in listed]
        dated = [d for d in dated if d[0][1] is not None]
        if self.polls is not None:
            dated = dated[: self.polls - first]
        if not dated:
            return
        carried = self._latest(spark, "carried", batch_id, rows.schema) if self.pairs else None
        before = carried.agg(F.max("captured_at"), F.max("snapshot_id")).first() if carried is not None else None
        results, number = [], first
        for (_, options), part in groupby(dated, key=lambda d: d[0]):
            polls = [(at, s) for _, at, s in part]
            own = rows.filter(F.col("snapshot_id").isin([s for _, s in polls]))
            index = [(s, at, number + k) for k, (at, s) in enumerate(polls)]
            if before is not None and before[1] is not None:
                own, index = carried.unionByName(own), [(before[1], before[0], number - 1), *index]
            known = spark.createDataFrame(index, "snapshot_id bigint, captured_at timestamp, snapshot_seq bigint")
            groups = self.groups
            if groups is not None:
                groups = groups.filter(F.col("snapshot_id").isin([i[0] for i in index]))
            tables = offset_tables(own, groups=groups, snapshots=known, since=index[0][2])
            results.append(self.analyse(tables, options))
            number += len(polls)
            if self.pairs:
                before = polls[-1]
                carried = rows.filter(F.col("snapshot_id") == before[1])
        out = reduce(DataFrame.unionByName, results)
        out.write.mode("overwrite").parquet(f"{self.folder}/out/batch_id={batch_id}")
        if self.pairs:
            carried.write.mode("overwrite").parquet(f"{self.folder}/carried/{batch_id}")
        done = spark.createDataFrame([(first, number - first)], PROGRESS).coalesce(1)
        done.write.mode("overwrite").parquet(f"{self.folder}/progress/{batch_id}")
        self.taken = number

    def until_done(self, query: StreamingQuery, every: float = 0.2) -> None:
        """Wait for the end of the stream or of the budget of polls, and stop it then."""
        while query.isActive and (self.polls is None or self.taken < self.polls):
            query.awaitTermination(every)
        query.stop()
        if query.exception() is not None:
            raise query.exception()
