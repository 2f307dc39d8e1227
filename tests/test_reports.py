import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark import Options
from tidemark.operators.clean import error_rows, prepare
from tidemark.plans import documents, reports


def group(s, g, raw="Stable"):
    return dict(snapshot_id=s, group_id=g, raw_state=raw, member_count=1, describe_failed=False)


@pytest.fixture(scope="module")
def tables(make):
    """Two groups, two topics with the same lag; a third topic far behind; one silent."""
    steady = {"t1": {0: 90}, "t2": {0: 90}}
    committed = {
        1: {"a": {"t1": {0: 80}, "t2": {0: 80}}, "b": steady, "late": {"t3": {0: 0, 1: 0}}, "mute": {"t1": {0: -1}}},
        2: {"a": steady, "b": steady, "late": {"t3": {0: 0, 1: 0}}, "mute": {"t1": {0: -1}}},
    }
    ends = {s: {"t1": {0: 100}, "t2": {0: 100}, "t3": {0: 3000 + 100 * s, 1: 1000}} for s in (1, 2)}
    configs = make.frame("topic_configs", [
        dict(topic="t1", key="retention.ms", value="86400000"),
        dict(topic="t1", key="secret", value=""),
    ])
    parts = [
        dict(snapshot_id=2, topic="t1", topic_id="id1", partition=0, leader=3, replicas=[3, 1], isr=[3]),
        dict(snapshot_id=2, topic="t3", topic_id="id3", partition=1, leader=1, replicas=[1], isr=[1]),
        dict(snapshot_id=2, topic="t3", topic_id="id3", partition=0, leader=2, replicas=[2, 1, 3], isr=[2, 1]),
        dict(snapshot_id=2, topic="bad", partition=0, topic_error="UNKNOWN"),
        dict(snapshot_id=2, topic="lost", partition=0, partition_error="NO_LEADER"),
    ]
    groups = [group(s, g, "Empty" if g == "mute" else "Stable") for s in (1, 2) for g in ("a", "b", "late", "mute")]
    return make.tables(
        committed, ends, groups=groups,
        topic_configs=configs,
        topic_partitions=make.frame("topic_partitions", parts),
        brokers=make.frame("brokers", [dict(broker_id=1, host="h1", port=9092)]),
    )


@pytest.fixture(scope="module")
def prepared(tables):
    return prepare(tables, Options(show_empty=True))


@pytest.fixture(scope="module")
def report(prepared):
    return reports.report(prepared).cache()


def order(df):
    return [(r.group_id, r.topic) for r in df.collect()]


NAMES = [("a", "t1"), ("a", "t2"), ("b", "t1"), ("b", "t2"), ("late", "t3")]


def test_report(report):
    got = {(r.group_id, r.topic): r for r in report.collect()}
    assert sorted(got) == NAMES  # "mute" has no lag and so no row
    late = got["late", "t3"]
    assert (late.parts, late.lag, late.eta, late.remaining_sec) == (2, 4200, "-", -1)
    assert (late.new_rate, late.cons_rate, late.has_issues) == (10, 0, True)
    assert (late.eta_level, late.rate_level, late.lag_level) == ("red", "red", "white")
    fast = got["a", "t1"]
    assert (fast.consumed, fast.cons_rate, fast.remaining_sec, fast.eta) == (10, 1, 10, "0:00:10")
    assert (fast.has_issues, fast.eta_level) == (False, "green")


def test_sorting(report):
    assert order(reports.sort_report(report)) == NAMES
    by_lag = [("late", "t3"), ("b", "t2"), ("b", "t1"), ("a", "t2"), ("a", "t1")]
    assert order(reports.sort_report(report, "lag")) == by_lag  # descending, ties too
    assert order(reports.sort_report(report, "lag", reverse=False)) == by_lag[::-1]
    by_topic = sorted(NAMES, key=lambda n: (n[1], n[0]))
    assert order(reports.sort_report(report, "topic")) == by_topic
    assert order(reports.sort_report(report, "topic", reverse=True)) == by_topic[::-1]
    assert order(reports.sort_report(report, "eta", reverse=False))[0] == ("b", "t1")
    for key in reports.SORT_KEYS:
        forward = order(reports.sort_report(report, key, False))
        assert forward == order(reports.sort_report(report, key, True))[::-1]
        numbered = reports.number_report(report, key, False).orderBy("position")
        assert order(numbered) == forward


def test_legacy_sort_puts_missing_eta_last(report):
    ascending = report.orderBy(*reports.legacy_sort_columns("eta", False))
    assert order(ascending)[0] == ("a", "t1")
    assert order(ascending)[-1] == ("late", "t3")


def test_page(report):
    rows_ = reports.page(report, 1, 2, "group").collect()
    assert [(r.group_id, r.topic) for r in rows_] == [("a", "t2"), ("b", "t1")]
    assert (rows_[0].first_row, rows_[0].last_row, rows_[0].n_rows, rows_[0].percent) == (2, 3, 5, 60)
    beyond = reports.page(report, 99, 2, "group").collect()
    assert [(r.group_id, r.first_row, r.last_row) for r in beyond] == [("late", 5, 5)]
    assert reports.page(report.filter("false"), 0, 5).count() == 0


def test_pages_of_any_depth(report):
    """Every window equals the slice of the sorted rows, and none is a top-k of its offset."""
    names = [(r.group_id, r.topic) for r in reports.sort_report(report, "lag").collect()]
    for offset in range(5):
        for size in (1, 3, 9):
            found = reports.page(report, offset, size, "lag")
            assert [(r.group_id, r.topic) for r in found.collect()] == names[offset : offset + size]
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "TakeOrdered" not in plan and "Limit" not in plan


def test_follow(report):
    assert rows(reports.follow(report), "group_id", "lag") == [("late", 4200)]
    tied = report.filter("group_id <> 'late'")
    assert rows(reports.follow(tied), "group_id", "topic") == [("a", "t1")]
    assert rows(reports.follow(tied, "lag"), "group_id", "topic") == [("b", "t2")]


def test_totals(report):
    assert rows(reports.totals(report), "n_groups", "n_topics") == [(3, 5)]


def test_search(report):
    found = reports.search_report(report, "B T", "topic")
    assert rows(found, "match_index", "topic") == [(1, "t1"), (3, "t2")]
    assert reports.search_report(report, "").count() == 0


def test_filters_after_the_report(prepared, report):
    assert order(reports.filter_report(report, "^b", "2$")) == [("b", "t2")]
    with pytest.raises(ValueError):
        reports.filter_report(report, "(")
    options = Options(show_empty=True, only_issues=True, group_filter="l", topic_filter="t")
    only = reports.finish_report(report.drop("shown_group", "shown_topic"), options)
    assert order(only) == [("late", "t3")]


def test_anonymous_report_sorts_by_real_names(report):
    hidden = reports.finish_report(
        report.drop("shown_group", "shown_topic"), Options(anonymize=True)
    )
    assert order(reports.sort_report(hidden)) == NAMES
    first = reports.sort_report(hidden).first()
    assert first.shown_group.startswith("group ") and len(first.shown_group) == 12
    # A search looks at what is shown.
    assert reports.search_report(hidden, "late").count() == 0
    assert reports.search_report(hidden, first.shown_group).count() == 2


def test_shown_report(report):
    late = reports.shown_report(report.filter("group_id = 'late'")).first()
    assert (late.lag, late.since, late.new_rate, late.eta) == ("4.20K", "10.0", "10", "-")
    assert (late.par, late.cv) == ("1.52", "0.52")


def test_status(prepared):
    got = {r.status_key: r for r in reports.status(prepared).collect()}
    assert sorted(got) == ["a-t1", "a-t2", "b-t1", "b-t2", "late-t3", "mute-t1"]
    assert got["late-t3"].eta == ("OK", "ETA < 1m")  # -1 is below a minute here
    assert got["late-t3"].rate == ("ERROR", "Lag detected but no event consumption")
    assert got["mute-t1"].rate == ("OK", "")  # no lag row: judged with a lag of 0
    assert got["a-t1"].lag == ("OK", "")


def test_summary(prepared, tables):
    got = {(r.group_id, r.topic): r for r in reports.summary(prepared, tables.topic_configs)
           .filter("snapshot_id = 2").collect()}
    assert got["a", "t1"].configs == {"retention.ms": "86400000"}
    assert got["a", "t2"].configs is None
    assert (got["late", "t3"].lag_max, got["late", "t3"].lag_min) == (3200, 1000)
    assert got["mute", None].state == "EMPTY"


def test_tables(prepared, tables):
    lag = reports.lag_table(prepared).filter("group_id = 'late' and snapshot_id = 2").first()
    assert (lag.partitions, lag.state, lag.lag_median) == (2, "STABLE", 2100)
    shown = reports.summary_table(prepared).filter("topic = 't3' and snapshot_id = 2").first()
    assert (shown.partitions, shown.state, shown.state_level) == ("2/2", "ConsumerGroupState.STABLE", "green")
    known = reports.summary_table(prepared, tables.topic_partitions)
    assert known.filter("topic = 't1' and snapshot_id = 2").first().partitions == "1/1"
    assert reports.rate_table(prepared).count() == 6


def test_partition_detail(prepared, tables):
    detail = reports.partition_detail(prepared, tables.topic_partitions)
    assert rows(detail.filter("group_id = 'late'"), "partition", "lag", "lag_rank", "rate_rank", "replicas", "isr", "leader") == [
        (0, 3200, "high", "none", "(2,1,3)", "(2,1)", "2"),
        (1, 1000, "low", "none", "(1)", "(1)", "1"),
    ]
    unplaced = detail.filter("topic = 't2'").first()
    assert (unplaced.replicas, unplaced.isr, unplaced.leader) == ("-", "-", "-")
    late = detail.filter("group_id = 'late'")
    for key, first in [("partition", 0), ("lag", 0), ("topicoffset", 0), ("groupoffset", 0), ("rate", 0)]:
        assert rows(reports.number_detail(late, key), "partition", "position")[0] == (first, 1)


def test_ranks_of_wide_topics_are_the_same(prepared, monkeypatch):
    from tidemark.operators import ordering

    narrow = sorted(reports.partition_detail(prepared).collect())
    monkeypatch.setattr(ordering, "CHUNK", 1)
    assert not prepared.is_narrow()
    assert sorted(reports.partition_detail(prepared).collect()) == narrow


def test_topics(tables):
    info = reports.topic_info(tables.topic_partitions)
    assert rows(info, "topic", "partitions", "replication_factor") == [
        ("lost", 0, None), ("t1", 1, 2), ("t3", 2, 3)
    ]
    assert rows(reports.topic_info_parts(tables.topic_partitions), "topic", "partition", "nisrs") == [
        ("t1", 0, 1), ("t3", 0, 2), ("t3", 1, 1)
    ]
    one = reports.topic_metadata(tables.topic_partitions, "t1", tables.topic_configs).first()
    assert (one.topic_id, one.configs) == ("id1", {"retention.ms": "86400000"})
    with pytest.raises(LookupError):
        reports.topic_metadata(tables.topic_partitions, "none")


def merged(lines):
    def merge(a, b):
        for k, v in b.items():
            a[k] = merge(a[k], v) if isinstance(v, dict) and k in a else v
        return a

    result = {}
    for line in lines:
        merge(result, json.loads(line.document))
    return result


def joined(path, snapshot):
    """The files of a written document, one after the other by name."""
    folder = f"{path}/snapshot_id={snapshot}"
    names = sorted(f for f in os.listdir(folder) if f.endswith(".txt"))
    return json.loads("".join(open(f"{folder}/{n}").read() for n in names))


def test_summary_document(prepared, tables, tmp_path):
    lines = documents.summary_document(prepared, tables.topic_configs)
    documents.write_document(lines.repartition(7), str(tmp_path / "out"))
    for snapshot in (1, 2):
        whole = joined(str(tmp_path / "out"), snapshot)
        assert list(whole) == ["a", "b", "late", "mute"] == sorted(whole)
    assert whole["mute"] == {"state": "EMPTY", "topics": {}}
    assert set(whole["a"]["topics"]) == {"t1", "t2"}
    assert whole["a"]["topics"]["t1"] == {
        "partitions": 1, "lag_max": 10, "lag_min": 10, "par": 1.0, "cv": 0.0,
        "configs": {"retention.ms": "86400000"},
    }
    assert "configs" not in whole["a"]["topics"]["t2"]
    assert len(lines.filter("snapshot_id = 2").collect()) == 6  # an entry or an empty group each


def test_names_in_documents_are_escaped(make, tmp_path):
    odd = {'a"b': {"t\\\n": {0: 1}, "é": {0: 1}}, "x,}": {"]}": {0: 1}}}
    ends = {topic: {0: 9} for topics in odd.values() for topic in topics}
    tables = make.tables({5: odd}, {5: ends}, groups=[group(5, g) for g in odd])
    documents.write_document(documents.summary_document(prepare(tables)), str(tmp_path / "out"))
    whole = joined(str(tmp_path / "out"), 5)
    assert {g: set(v["topics"]) for g, v in whole.items()} == {g: set(t) for g, t in odd.items()}


def test_other_documents(prepared, tables, tmp_path):
    status = merged(documents.status_documents(prepared).collect())
    assert status["late-t3"]["rate"]["status"] == "ERROR"
    def topic_document(name, **more):
        documents.write_document(documents.topic_document(tables.topic_partitions, **more), str(tmp_path / name))
        return joined(str(tmp_path / name), 2)

    topics = topic_document("parts", parts=True)
    assert topics["topics"]["lost"] == {"name": "lost", "partitions": 0, "partinfo": []}
    assert topics["topics"]["t3"]["partinfo"][0] == {
        "id": 0, "leader": 2, "replicas": [2, 1, 3], "nisrs": [2, 1]
    }
    assert topic_document("bare")["topics"]["t3"] == {"name": "t3", "partitions": 2}
    brokers = documents.broker_documents(tables.brokers, "b0", "7")
    assert merged(brokers.collect()) == {
        "brokers": {"1": {"id": 1, "host": "h1", "port": 9092}}, "broker_name": "b0", "cluster_id": "7"
    }
    documents.write_documents(brokers, str(tmp_path / "out"))
    assert prepared.committed.sparkSession.read.json(str(tmp_path / "out")).count() == 1


def test_error_rows(make, tables):
    broken = tables.topic_offsets.withColumn("error", F.when(F.col("topic") == "t3", "X"))
    changed = type(tables)(**{**vars(tables), "topic_offsets": broken})
    assert rows(error_rows(changed).groupBy("kind").count(), "kind", "count") == [("topic", 4)]


def test_legacy_report(tables):
    got = reports.report(prepare(tables, Options(legacy=True, only_issues=True)))
    assert got.count() == 0  # without an ETA the legacy status is OK
