"""Offset tables stored so that partition lag needs no shuffle.

Both tables are bucketed by (snapshot, topic, partition), the keys of that join, in the same number of
buckets, and partitioned by the day of the capture. The join then meets bucket by bucket, and a range
of days prunes folders. Choose the number of buckets so that a bucket of a day has some 100 MB.

Buckets are not split at run time. Where one partition has so many groups that its bucket is far
larger than the others, keep the tables unbucketed: the shuffled join splits it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import LagTables

OFFSET_TABLES = ("group_offsets", "topic_offsets")
BUCKET = ("snapshot_id", "topic", "partition")


def _days(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("captured_at"))


def store_bucketed(tables: LagTables, name: str, folder: str, buckets: int) -> None:
    """Add the offset tables to the catalog tables `<name>_group_offsets` and
    `<name>_topic_offsets`, with their files under `folder`. More polls are appended."""
    for table in OFFSET_TABLES:
        # One file per bucket and day: rows meet by bucket before they are written.
        rows = _days(getattr(tables, table)).repartition(buckets, *BUCKET)
        (
            rows.write.mode("append").format("parquet").partitionBy("day")
            .bucketBy(buckets, *BUCKET).sortBy(*BUCKET)
            .option("path", f"{folder}/{table}")
            .saveAsTable(f"{name}_{table}")
        )


def load_bucketed(
    spark: SparkSession, name: str, days: tuple[date, date] | None = None, **more: DataFrame
) -> LagTables:
    """The stored offset tables, of some days if asked for; `more` are the other tables.

    Spark gives buckets up where a filter by broadcast join (on groups) lies between the scan and
    the join that they are for; this session is told not to."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")

    def table(of: str) -> DataFrame:
        rows = spark.table(f"{name}_{of}")
        return (rows.filter(F.col("day").between(*days)) if days else rows).drop("day")

    return LagTables(**{t: table(t) for t in OFFSET_TABLES}, **more)
