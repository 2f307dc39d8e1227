"""Session settings the operators are written for, and the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Offsets shrink to a tenth or less in a shuffle: with 64 MB a task would sort more than a gigabyte.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # What is broadcast goes by the bytes of files, in which offsets take a twentieth or less.
    "spark.sql.sources.fileCompressionFactor": "16",
    # Joins on (snapshot, topic, partition) split a topic with very many groups.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming state is one row per partition and group: keep it out of the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


def small_tasks(spark: SparkSession) -> None:
    """Take the recommended size of a shuffled partition and of what is broadcast, unless the session
    has one of its own."""
    for name in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.sources.fileCompressionFactor"):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, RECOMMENDED_CONF[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as the cluster names it.

    Only a local master, where driver and executors are one process, gets a folder
    of its own when none is named.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """Compute once, keep the rows in the shared folder and cut the lineage: for small
    results that several parts of a plan read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast after counting. Size estimates do not know that an aggregate is small, so
    without this the large side of the join would be shuffled for nothing."""
    return F.broadcast(df) if df.count() <= max_rows else df


def broadcast_by_count(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast up to so many rows, and never more. Spark goes by the bytes of the files otherwise, in
    which a row can take less than one byte: ten megabytes of them are more than a driver's memory."""
    return F.broadcast(df) if df.count() <= max_rows else df.hint("merge")
