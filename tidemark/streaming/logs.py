"""Offset tables from logs that keep growing, filled in at every poll.

The log's source also carries marks: rows without a topic, at the time of a poll, with its id as
offset. Polls are taken at multiples of `period`, and a record belongs to the first one at or after
its time. Records are held in files until their period is closed (see `closed`), without keyed state;
then they combine, and what each partition had before takes over where it has no record. The combined
rows, one per partition and period with the time until which it holds, are the folder `closed`: the
result is a narrow pass over it, and the next closed polls go on from its last rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.streaming.closed import REACHED, Folders


def log_points(log: DataFrame, keys: list[str], time: str, value, period: int, delay: str) -> DataFrame:
    """The records with their `value` as `last`, `period_end`, and `due`, the time that the log must
    have reached for the period to be closed. Periods are closed on the right, as polls see what has
    happened by then. A closing row has no value."""
    rows = log.withColumn("_at", F.col(time) - F.expr("interval 1 microsecond"))
    end = F.window("_at", f"{period} seconds")["end"]
    last = F.when(F.col("offset").isNotNull(), value).alias("last")
    rows = rows.select("_at", *keys, last, end.alias("period_end"))
    return rows.withColumn("due", F.col("period_end") + F.expr(f"interval {delay}"))


def end_offset_points(log: DataFrame, period: int, delay: str) -> DataFrame:
    return log_points(log, ["topic", "partition"], "timestamp", F.col("offset"), period, delay)


def committed_points(log: DataFrame, period: int, delay: str) -> DataFrame:
    """The last commit of a period (the largest offset among commits with the same time)."""
    last = F.struct(F.unix_micros("commit_ts").alias("us"), "offset")
    return log_points(log, ["group_id", "topic", "partition"], "commit_ts", last, period, delay)


@dataclass
class OffsetsAtPolls(Folders):
    """
    The sink of `end_offset_points` or `committed_points`: the batch tables of `sources.logs`.

    committed  group_offsets with the latest commit so far; else topic_offsets with the offset
               after the last record so far, which never moves back
    folder     shared folder for results (`out`), records of open periods (`held`), the combined rows
               (`closed`) and times (`reached`)

    A record of a period that has been closed is late and dropped. Folders are named by micro-batch,
    so a repeated one replaces its own output.
    """

    folder: str
    committed: bool = False

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.session or batch.sparkSession
        own = f"{self.folder}/held/{batch_id}"
        batch.write.mode("overwrite").parquet(own)
        due = F.max(F.when(F.col("last").isNotNull(), F.col("due")))
        came, due = spark.read.schema(batch.schema).parquet(own).agg(F.max("_at"), due).first()
        last = self._latest(spark, "reached", batch_id, REACHED)
        before = last.first()[0] if last is not None else None
        until = max((t for t in (before, came) if t is not None), default=None)
        if until is not None:
            rows = self._due(spark, batch.schema, batch_id, before, until).filter("last is not null")
            if not rows.isEmpty():
                self._fill(spark, rows, batch_id)
        reached = spark.createDataFrame([(until, until, due)], REACHED).coalesce(1)
        reached.write.mode("overwrite").parquet(f"{self.folder}/reached/{batch_id}")

    def _fill(self, spark: SparkSession, rows: DataFrame, batch_id: int) -> None:
        # The partition leads the sorts, as it differs most.
        keys = ["partition", "group_id", "topic"] if self.committed else ["partition", "topic"]
        offset = F.col("last.offset") if self.committed else F.col("last")
        # The polls of this micro-batch.
        marks = rows.filter("topic is null").select("period_end", offset.alias("offset")).distinct().collect()
        points = rows.filter("topic is not null").select(*keys, "period_end", "last")
        schema = points.withColumn("until", F.col("period_end")).schema
        carried = self._latest(spark, "closed", batch_id, schema)
        if carried is not None:
            points = carried.filter("until is null").drop("until").unionByName(points)
        # One shuffle: a key has at most one row per period of this micro-batch, and the one carried.
        points = points.repartition(*keys).groupBy(*keys, "period_end").agg(F.max("last").alias("last"))
        order = Window.partitionBy(*keys).orderBy("period_end")
        if not self.committed:  # an end never moves back
            points = points.withColumn("last", F.max("last").over(order))
        points = points.withColumn("until", F.lead("period_end").over(order))
        target = f"{self.folder}/closed/{batch_id}"
        points.select(*schema.names).write.mode("overwrite").parquet(target)
        for i in self._ids(spark, "closed", batch_id)[:-1]:  # the latest is needed to repeat this one
            self._delete(spark, f"closed/{i}")
        name, shift = ("committed_offset", 0) if self.committed else ("end_offset", 1)
        if marks:
            polls = F.array(*[F.struct(F.lit(m.period_end).alias("at"), F.lit(m.offset).alias("id")) for m in marks])
            until = F.coalesce("until", F.lit("9999-12-31").cast("timestamp"))
            seen = lambda m: (m["at"] >= F.col("period_end")) & (m["at"] < until)
            points = spark.read.schema(schema).parquet(target).select("*", offset.alias("offset"))
            filled = points.select(*keys, "offset", F.explode(F.filter(polls, seen)).alias("poll"))
            filled.select(
                F.col("poll.id").alias("snapshot_id"),
                F.col("poll.at").alias("captured_at"),
                *keys,
                (F.col("offset") + shift).alias(name),
                F.lit(None).cast("string").alias("error"),
            ).write.mode("overwrite").parquet(f"{self.folder}/out/batch_id={batch_id}")
