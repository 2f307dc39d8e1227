"""The poll loop as a foreachBatch sink: any batch operator, at irregular intervals.

The last finished snapshot is kept as a table and becomes the first of the next pair. The
time between two polls is measured, not assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.tables import LagTables


def tables_of(rows: DataFrame, since: int = 0) -> LagTables:
    """Snapshot rows (one per group and partition) as the two offset tables. With a column
    `raw_state` (and member_count, describe_failed) they also give the groups' states, so
    that EMPTY groups are hidden on every poll. since: number of the first poll."""
    blank = F.lit(None).cast("string").alias("error")
    return LagTables(
        group_offsets=rows.select(
            "snapshot_id",
            "captured_at",
            "group_id",
            "topic",
            "partition",
            "committed_offset",
            blank,
        ),
        topic_offsets=rows.filter(F.col("end_offset").isNotNull())
        .groupBy("snapshot_id", "topic", "partition")
        .agg(F.max("captured_at").alias("captured_at"), F.max("end_offset").alias("end_offset"))
        .withColumn("error", blank),
        groups=_groups_of(rows),
        since=since,
    )


def _groups_of(rows: DataFrame) -> DataFrame | None:
    if "raw_state" not in rows.columns:
        return None
    given = {
        "member_count": F.lit(0),
        "describe_failed": F.lit(False),
        "is_simple": F.lit(False),
    }
    filled = [F.col(c) if c in rows.columns else v.alias(c) for c, v in given.items()]
    return rows.select("snapshot_id", "group_id", "raw_state", *filled).distinct()


DONE = "last bigint, number bigint, newest bigint"


@dataclass
class SnapshotLoop:
    """
    analyse  batch operator: tables of two or more finished snapshots -> result rows
    folder   shared folder for results (`out`), rows still needed (`carried`) and progress (`done`)

    A snapshot counts as finished when a row of a later one arrives; its own rows may be
    spread over any number of micro-batches before that, and are dropped after it. Every
    micro-batch writes folders named by its id, so a repeated one replaces its own output. It writes
    its new rows only; what came before is read from where it was written, and deleted once
    no open or last finished snapshot has rows in it. The number of a snapshot is kept, so that
    pairing and a limit of pairs mean the same as over the whole history.
    """

    analyse: Callable[[LagTables], DataFrame]
    folder: str
    # The session the stream was started from: Spark plans a micro-batch's own session without
    # adaptive execution.
    session: SparkSession | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.session or batch.sparkSession
        last, number = self._state(spark, batch_id)
        fresh = batch if last is None else batch.filter(F.col("snapshot_id") > last)
        fresh.write.mode("overwrite").parquet(f"{self.folder}/carried/{batch_id}")
        rows = self._rows(spark, batch_id + 1, last, batch.schema)
        # The polls at hand; one narrow column is read.
        listed = rows.filter("snapshot_id is not null").select("snapshot_id").distinct()
        ids = sorted(r.snapshot_id for r in listed.collect())
        newest = ids[-1] if ids else None
        if len(ids) > 1 and ids[-2] != last:
            self._emit(rows.filter(F.col("snapshot_id") < newest), batch_id, number or 0)
            last, number = ids[-2], (number or 0) + len(ids) - 2
        done = spark.createDataFrame([(last, number, newest)], DONE).coalesce(1)
        done.write.mode("overwrite").parquet(f"{self.folder}/done/{batch_id}")
        self._forget(spark, batch_id)

    def _ids(self, spark: SparkSession, name: str, before: int) -> list[int]:
        """The micro-batches before this one that have left such a folder, whole."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(i for f in found if (i := int(f.getPath().getParent().getName())) < before)

    def _done(self, spark: SparkSession, batch_id: int) -> tuple:
        return tuple(spark.read.schema(DONE).parquet(f"{self.folder}/done/{batch_id}").first())

    def _state(self, spark: SparkSession, batch_id: int) -> tuple[int | None, int | None]:
        """The last finished snapshot before this micro-batch, and its number."""
        ids = self._ids(spark, "done", batch_id)
        return self._done(spark, ids[-1])[:2] if ids else (None, None)

    def _rows(self, spark: SparkSession, before: int, last: int | None, schema=None) -> DataFrame:
        """The rows of the last finished snapshot and of later ones."""
        paths = [f"{self.folder}/carried/{i}" for i in self._ids(spark, "carried", before)]
        read = spark.read if schema is None else spark.read.schema(schema)
        rows = read.parquet(*paths)
        return rows if last is None else rows.filter(F.col("snapshot_id") >= last)

    def _emit(self, rows: DataFrame, batch_id: int, since: int) -> None:
        result = self.analyse(tables_of(rows, since))
        result.write.mode("overwrite").parquet(f"{self.folder}/out/batch_id={batch_id}")

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Delete what neither this micro-batch, should it be repeated, nor a later one needs: the
        rows of micro-batches that saw no snapshot from the last finished one on."""
        last, _ = self._state(spark, batch_id)
        for i in self._ids(spark, "carried", batch_id):
            newest = self._done(spark, i)[2]
            if newest is not None and (last is None or newest >= last):
                continue
            for name in ("carried", "done") if i < batch_id - 1 else ("carried",):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{i}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, spark: SparkSession, last_batch_id: int) -> None:
        """After the stream has ended: also take the newest snapshot as finished."""
        last, number = self._state(spark, last_batch_id + 1)
        if self._ids(spark, "carried", last_batch_id + 1):
            rows = self._rows(spark, last_batch_id + 1, last)
            self._emit(rows, last_batch_id + 1, number or 0)

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/out").drop("batch_id")

    def run(self, rows: DataFrame, **trigger) -> StreamingQuery:
        """Start on a stream of snapshot rows, e.g. run(rows, processingTime="5 seconds")."""
        self.session = rows.sparkSession
        return (
            rows.writeStream.foreachBatch(self)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def append_parquet(
    result: DataFrame, folder: str, state_partitions: int | None = None, **trigger
) -> StreamingQuery:
    """Write a windowed result (see `windows`) as it becomes final.

    The number of state partitions is fixed when a stream first starts, and nothing merges
    small ones later as in a batch; `state_partitions` chooses it for this stream alone.
    """
    conf, name = result.sparkSession.conf, "spark.sql.shuffle.partitions"
    usual = conf.get(name)
    conf.set(name, str(state_partitions or usual))
    try:
        return (
            result.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        conf.set(name, usual)
