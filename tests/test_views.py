"""The derived tables: written when asked for, and the same as from the whole log."""

import os

import pytest
from conftest import rows

from tidemark.sources.logs import end_offsets_from_log
from tidemark.workload import views
from tidemark.workload.views import Views, daily_log, stored_tables, topic_log

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_only_the_tables_asked_for_are_derived(spark):
    folder = FOLDER + "/"  # a path of its own, so that nothing is there yet
    tables = stored_tables(spark, folder, only=("groups",))
    assert tables.groups.count() > 0 and tables.group_offsets is None
    assert sorted(os.listdir(views._stored_of(spark, folder).folder)) == ["groups", "index"]


def test_end_offsets_of_daily_counts_are_those_of_the_log(spark):
    v = Views(spark, FOLDER)
    columns = ["snapshot_id", "captured_at", "topic", "partition", "end_offset"]
    got, want = (end_offsets_from_log(log(v.records), v.index) for log in (daily_log, topic_log))
    assert rows(got, *columns) == rows(want, *columns) and got.count() > 0


def test_a_micro_batch_takes_polls_however_many_files_they_have(spark, tmp_path):
    """A large poll is written in several files; the replayed stream counts polls, not files."""
    folder = str(tmp_path / "in")
    rows = spark.range(60).selectExpr("id", "cast(id % 3 as int) + 1 as arrived").repartition(5)
    rows.write.partitionBy("arrived").parquet(folder)
    files = [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]
    assert views._dated_by_poll(spark, folder) == -(-len(files) // 3) > 1
