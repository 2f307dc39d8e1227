"""Snapshot tables: readers (batch and stream) and the cleaning each scan applies."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import SCHEMAS


def read_table(
    spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options
) -> DataFrame:
    """One of the tables of `schemas.SCHEMAS`, with its fixed schema."""
    return spark.read.format(fmt).schema(SCHEMAS[name]).options(**options).load(path)


def stream_table(
    spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options
) -> DataFrame:
    """The same table as a stream of arriving files."""
    return spark.readStream.format(fmt).schema(SCHEMAS[name]).options(**options).load(path)


@dataclass(frozen=True)
class LagTables:
    """The tables one analysis reads. Only the two offset tables are required.

    `snapshots` (snapshot_id, captured_at[, snapshot_seq]) is the list of polls. Without
    it the list is derived from the other tables, which costs a narrow scan of each. A poll
    that the tables have and the list lacks is an error when the rates are computed.
    `since` is the number of the first poll, where earlier ones were analysed before.
    """

    group_offsets: DataFrame
    topic_offsets: DataFrame
    groups: DataFrame | None = None
    snapshots: DataFrame | None = None
    topic_partitions: DataFrame | None = None
    topic_configs: DataFrame | None = None
    brokers: DataFrame | None = None
    since: int = 0

    @classmethod
    def names(cls) -> list[str]:
        """The tables among the fields."""
        return [name for name in cls.__annotations__ if name != "since"]

    def between(self, first: int, last: int) -> "LagTables":
        """Only the snapshots first..last, as a filter that reaches every scan."""

        def cut(df):
            if df is None or "snapshot_id" not in df.columns:
                return df
            return df.filter(F.col("snapshot_id").between(first, last))

        return replace(self, **{name: cut(getattr(self, name)) for name in self.names()})

    def latest_pair(self) -> "LagTables":
        """The last two snapshots: two scalars come to the driver, nothing else."""
        listed = [self.snapshots] if self.snapshots is not None else self._polled()
        ids = reduce(DataFrame.unionByName, [t.select("snapshot_id") for t in listed])
        last = ids.agg(F.max("snapshot_id")).first()[0]
        if last is None:
            return self
        before = ids.filter(F.col("snapshot_id") < last).agg(F.max("snapshot_id")).first()[0]
        return self.between(last if before is None else before, last)

    def _polled(self) -> list[DataFrame]:
        """The tables that tell which polls there were; a poll may have seen no group."""
        polled = (self.group_offsets, self.topic_offsets, self.groups)
        return [t for t in polled if t is not None]

    @staticmethod
    def load(spark: SparkSession, folder: str, fmt: str = "parquet", **options) -> "LagTables":
        """Every table found as `<folder>/<name>`; missing optional ones stay None."""
        path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()

        def table(name):
            target = path(f"{folder}/{name}")
            if not target.getFileSystem(conf).exists(target):
                return None
            return read_table(spark, name, f"{folder}/{name}", fmt, **options)

        return LagTables(**{name: table(name) for name in LagTables.names()})


def group_scan(groups: DataFrame) -> DataFrame:
    """One row per group and snapshot; which duplicate survives is not defined."""
    return groups.dropDuplicates(["snapshot_id", "group_id"])


def committed_scan(group_offsets: DataFrame) -> DataFrame:
    """Committed offsets. A negative offset means "nothing committed": the row stays, so
    that the group still has the topic, but its offset becomes NULL."""
    offset = F.col("committed_offset")
    return group_offsets.filter(F.col("error").isNull()).withColumn(
        "committed_offset", F.when(offset >= 0, offset)
    )


def end_offset_scan(topic_offsets: DataFrame) -> DataFrame:
    """End offsets of the partitions that answered without an error."""
    return topic_offsets.filter(F.col("error").isNull()).select(
        "snapshot_id", "topic", "partition", "end_offset"
    )


def topic_scan(topic_partitions: DataFrame) -> DataFrame:
    """Partition metadata without topics in error. Partitions in error are kept here and
    left out by the readers that count or list partitions."""
    return topic_partitions.filter(F.col("topic_error").isNull())


def config_scan(topic_configs: DataFrame) -> DataFrame:
    """Settings that have a value."""
    return topic_configs.filter(F.col("value") != "")


def config_maps(topic_configs: DataFrame) -> DataFrame:
    """(topic, configs map). A topic has one row per setting name, and the broker software
    fixes the list of names, so the map is bounded whatever the number of topics."""
    return (
        config_scan(topic_configs)
        .groupBy("topic", "key")
        .agg(F.max("value").alias("value"))
        .groupBy("topic")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(
                "configs"
            )
        )
    )
