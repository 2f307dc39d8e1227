import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark import LagTables  # noqa: E402
from tidemark.schemas import SCHEMAS  # noqa: E402
from tidemark.session import configure  # noqa: E402

EPOCH = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "4")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Maker:
    """Tables from nested literals: {snapshot: {group: {topic: {partition: offset}}}}."""

    def __init__(self, spark):
        self.spark = spark

    def frame(self, name, rows):
        columns = SCHEMAS[name].names
        data = [tuple(row.get(c) for c in columns) for row in rows]
        return self.spark.createDataFrame(data, SCHEMAS[name])

    def tables(self, committed, ends, groups=None, times=None, **more):
        at = lambda s: EPOCH + timedelta(seconds=(times or {}).get(s, 10 * s))
        rows = [
            dict(snapshot_id=s, captured_at=at(s), group_id=g, topic=t, partition=p, committed_offset=o)
            for s, by_group in committed.items()
            for g, by_topic in by_group.items()
            for t, by_part in by_topic.items()
            for p, o in by_part.items()
        ]
        end_rows = [
            dict(snapshot_id=s, captured_at=at(s), topic=t, partition=p, end_offset=o)
            for s, by_topic in ends.items()
            for t, by_part in by_topic.items()
            for p, o in by_part.items()
        ]
        if groups is not None:
            groups = self.frame("groups", groups)
        return LagTables(
            group_offsets=self.frame("group_offsets", rows),
            topic_offsets=self.frame("topic_offsets", end_rows),
            groups=groups,
            **more,
        )

    def column(self, kind, values, name="x"):
        return self.spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


@pytest.fixture(scope="session")
def make(spark):
    return Maker(spark)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
