import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark import Options
from tidemark.operators import ordering
from tidemark.operators.clean import prepare, topic_usage
from tidemark.operators.lag import lag_stats, partition_lag


def one(make, committed, ends, options=Options(), **kw):
    tables = make.tables({1: {"g": {"t": committed}}}, {1: {"t": ends}})
    found = lag_stats(prepare(tables, options), **kw).collect()
    return found[0] if found else None


def test_basic_statistics(make):
    row = one(make, {0: 9, 1: 18, 2: 25, 3: 32}, {0: 10, 1: 20, 2: 30, 3: 40})
    assert (row.lag_min, row.lag_max, row.lag_sum, row.lag_mean) == (1, 8, 16, 4.0)
    assert row.lag_median == 3  # (2 + 5) / 2, cut
    assert row.par == 2.0
    assert row.cv == pytest.approx(math.sqrt(7.5) / 4, rel=1e-15)
    assert row.n_parts == 4


def test_odd_median(make):
    assert one(make, {0: 9, 1: 8, 2: 5}, {0: 10, 1: 10, 2: 10}).lag_median == 2


def test_committed_ahead_of_end_is_no_lag(make):
    row = one(make, {0: 15}, {0: 10})
    assert (row.lag_sum, row.par, row.cv) == (0, 0.0, 0.0)


def test_partition_on_one_side_only(make):
    tables = make.tables({1: {"g": {"t": {0: 1, 1: 1}}}}, {1: {"t": {1: 5, 2: 5}}})
    assert rows(partition_lag(prepare(tables)), "partition", "lag") == [(1, 4)]


def test_large_lags_keep_their_last_digit(make):
    big = 9007199254740993
    row = one(make, {0: 0, 1: 0}, {0: big, 1: big})
    assert (row.lag_median, row.lag_max, row.cv) == (big, big, 0.0)


def test_squares_beyond_38_digits_fall_back_to_floating_point(make):
    big = 2**61
    row = one(make, {0: 0, 1: 0, 2: 0}, {0: big, 1: big, 2: 0})
    assert row.cv == pytest.approx(math.sqrt(2) / 2, rel=1e-6)


def test_uncommitted_partition_is_ignored(make):
    row = one(make, {0: 4, 1: -1}, {0: 10, 1: 10})
    assert (row.n_parts, row.lag_sum) == (1, 6)


def test_nothing_committed_gives_no_row(make):
    assert one(make, {0: -1}, {0: 10}) is None


def test_unknown_topic_gives_no_row(make):
    tables = make.tables({1: {"g": {"t": {0: 1}}}}, {1: {"other": {0: 5}}})
    assert lag_stats(prepare(tables)).count() == 0


@pytest.mark.parametrize("median", [True, False])
def test_rows_with_errors_do_not_count(make, median):
    tables = make.tables({1: {"g": {"t": {0: 1, 1: 1}}}}, {1: {"t": {0: 5, 1: 9}}})
    bad = F.when(F.col("partition") == 1, "NOT_LEADER")
    tables = type(tables)(
        group_offsets=tables.group_offsets,
        topic_offsets=tables.topic_offsets.withColumn("error", bad),
    )
    assert rows(lag_stats(prepare(tables), median), "n_parts", "lag_sum") == [(1, 4)]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_against_brute_force(make, monkeypatch, chunk):
    """Random groups; with a tiny chunk every topic takes the way of the wide ones."""
    monkeypatch.setattr(ordering, "CHUNK", chunk)
    rng = random.Random(7)
    ends = {t: {p: rng.choice([5, 50, 10**15]) + rng.randrange(9) for p in range(n)} for t, n in
            {"a": 1, "b": 2, "c": 7, "d": 20, "e": 33}.items()}
    committed = {
        g: {t: {p: max(0, e - rng.randrange(12)) for p, e in parts.items() if rng.random() < 0.8}
            for t, parts in ends.items()}
        for g in ("g1", "g2", "g3")
    }
    tables = make.tables({1: committed}, {1: ends})
    got = {(r.group_id, r.topic): r for r in lag_stats(prepare(tables)).collect()}
    for g, topics in committed.items():
        for t, parts in topics.items():
            values = sorted(ends[t][p] - o for p, o in parts.items())
            if not values:
                assert (g, t) not in got
                continue
            r, n = got[g, t], len(values)
            mean = sum(values) / n
            assert (r.n_parts, r.lag_min, r.lag_max, r.lag_sum) == (
                n, values[0], values[-1], sum(values))
            assert r.lag_median == (values[(n - 1) // 2] + values[n // 2]) // 2
            spread = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
            assert r.cv == pytest.approx(spread / mean if mean else 0.0, rel=1e-12)
            assert 0 <= r.cv <= math.sqrt(n - 1) + 1e-9
            assert r.lag_min <= r.lag_median <= r.lag_max
            if mean:
                assert 1 <= r.par <= n
                assert r.par == values[-1] / mean


def test_middle_values_of_any_bigints(spark):
    rng = random.Random(3)
    data = {k: [rng.randrange(-(2**63), 2**63) >> rng.choice([0, 20, 45, 60]) for _ in range(n)]
            for k, n in enumerate([1, 2, 3, 10, 51, 200])}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k int, v bigint")
    got = {r.k: (r.low, r.high) for r in ordering.exact_middle(df, ["k"], "v").collect()}
    for k, values in data.items():
        s = sorted(values)
        assert got[k] == (s[(len(s) - 1) // 2], s[len(s) // 2])


def test_row_order_does_not_matter(make):
    committed = {p: (p * 37) % 11 for p in range(20)}
    ends = {p: 20 + (p * 17) % 13 for p in range(20)}
    forward = one(make, committed, ends)
    backward = one(make, dict(reversed(committed.items())), dict(reversed(ends.items())))
    assert forward == backward


def test_topic_usage_unites_partitions_of_all_groups(make):
    committed = {1: {"a": {"t": {0: 1, 1: 1}}, "b": {"t": {1: 1, 5: 1}}, "c": {"t": {9: -1}}}}
    tables = make.tables(committed, {1: {"t": {0: 1}}})
    assert rows(topic_usage(prepare(tables)), "topic", "n_groups", "n_partitions") == [("t", 3, 3)]


def test_dense_sequence(spark):
    ids = [-(2**63), -5, 0, 1, 7, 2**21, 2**21 + 1, 2**42, 2**42 + 2**21, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "id bigint")
    got = ordering.dense_sequence(df, "id", "seq").collect()
    assert sorted((r.seq, r.id) for r in got) == list(enumerate(ids))


def test_positions(spark):
    data = [(g, (i * 7) % 10, i) for g in "ab" for i in range(40)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(5)
    got = ordering.with_position(df, [F.col("v").desc(), F.col("i")], ["g"]).collect()
    for g in "ab":
        order = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))
        want = {d[2]: n for n, d in enumerate(order, 1)}
        assert {r.i: r.position for r in got if r.g == g} == want


def test_legacy_statistics(make):
    row = one(make, {0: 15, 1: 8}, {0: 10, 1: 10}, Options(legacy=True))
    assert (row.lag_min, row.lag_sum, row.lag_median) == (-5, -3, -1.5)
    tables = make.tables({1: {"g": {"t": {0: 1}}}}, {1: {"other": {0: 5}}})
    assert rows(lag_stats(prepare(tables, Options(legacy=True))), "n_parts", "lag_sum",
                "lag_median") == [(0, 0, 0.0)]


def test_middle_of_counted_values(spark):
    """A value that counts n times is as n rows."""
    data = [("a", 5, 3), ("a", -1, 2), ("b", 1 << 50, 1), ("b", 7, 1), ("c", 4, 9)]
    df = spark.createDataFrame(data, "k string, v bigint, n bigint")
    got = {r.k: (r.low, r.high) for r in ordering.exact_middle(df, ["k"], "v", "n").collect()}
    assert got == {"a": (5, 5), "b": (7, 1 << 50), "c": (4, 4)}
