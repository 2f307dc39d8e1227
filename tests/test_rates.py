import random
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark import Options
from tidemark.operators import ordering
from tidemark.operators.clean import prepare
from tidemark.operators.lag import lag_stats
from tidemark.operators.rates import (
    arrival_rates,
    group_rates,
    partition_history,
    partition_rates,
    rates,
)
from tidemark.operators.skew import rate_skew


def pair(make, first, second, ends1=None, ends2=None, dt=10, options=Options()):
    """Rates of group g, topic t between two polls dt seconds apart."""
    committed = {1: {"g": {"t": first}}, 2: {"g": {"t": second}}}
    ends = {1: {"t": ends1 or {}}, 2: {"t": ends2 or {}}}
    return prepare(make.tables(committed, ends, times={1: 0, 2: dt}), options)


def test_vanished_partition_is_negative_consumption(make):
    p = pair(make, {0: 40, 1: 83}, {0: 92}, dt=5)
    assert rows(group_rates(p, False), "events_consumed", "consumption_rate") == [(-31, -6.2)]
    assert rows(partition_rates(p), "partition", "rate") == [(0, 10.4)]


def test_new_partition_does_not_count(make):
    assert rows(group_rates(pair(make, {0: 10}, {0: 20, 1: 100})), "events_consumed") == [(10,)]


def test_only_new_partitions(make):
    p = pair(make, {0: 10}, {5000: 7})  # in another chunk of partition ids
    assert rows(group_rates(p), "events_consumed") == [(-10,)]


def test_group_or_topic_in_one_snapshot_only(make):
    committed = {
        1: {"stays": {"t": {0: 1}, "gone": {0: 1}}, "left": {"t": {0: 1}}},
        2: {"stays": {"t": {0: 3}, "new": {0: 1}}, "came": {"t": {0: 1}}},
    }
    p = prepare(make.tables(committed, {1: {}, 2: {}}))
    assert rows(group_rates(p), "group_id", "topic") == [("stays", "t")]


def test_same_time_gives_no_rate(make):
    p = pair(make, {0: 1}, {0: 2}, {0: 5}, {0: 6}, dt=0)
    assert rates(p).count() == 0
    assert partition_rates(p).count() == 0
    assert arrival_rates(p).count() == 0


def test_arrival_sums_each_side_on_its_own(make):
    p = pair(make, {0: 1}, {0: 1, 1: 1}, {0: 10}, {0: 20, 1: 100})
    assert rows(rates(p), "arrival_rate") == [(11.0,)]


def test_arrival_without_first_end_offsets_is_zero(make):
    committed = {s: {"g": {"t": {0: s}}} for s in (1, 2)}
    p = prepare(make.tables(committed, {2: {"t": {0: 50}}}))
    assert rows(rates(p), "consumption_rate", "arrival_rate") == [(0.1, 0.0)]


def test_arrival_of_a_topic_first_silent_then_committed(make):
    p = pair(make, {0: -1}, {0: 5}, {0: 40}, {0: 50})
    # Nothing was asked for at first, so the first sum is 0.
    assert rows(rates(p), "events_consumed", "arrival_rate") == [(0, 5.0)]


def test_silent_topic_has_a_rate_row_without_lag(make):
    p = pair(make, {0: -1}, {0: -1}, {0: 40}, {0: 50})
    assert lag_stats(p).count() == 0
    assert rows(rates(p), "events_consumed", "remaining_sec", "remaining_hms", "lag_sum",
                "n_parts", "par") == [(0, 0, "-", None, None, None)]


@pytest.mark.parametrize(
    "consumed, arrived, method, want",
    [
        (300, 100, "net-rate", (5, "0:00:05")),
        (100, 300, "net-rate", (-1, "-")),
        (0, 0, "net-rate", (-1, "-")),
        (100, 100, "net-rate", (-1, "-")),
        (300, 100, "simple", (3, "0:00:03")),
        (0, 100, "simple", (-1, "-")),
    ],
)
def test_eta(make, consumed, arrived, method, want):
    end = 1000 + arrived
    p = pair(make, {0: end - 100 - consumed}, {0: end - 100}, {0: 1000}, {0: end}, 10,
             Options(eta_method=method))
    assert rows(rates(p), "lag_sum", "remaining_sec", "remaining_hms") == [(100, *want)]


def history(make, n, **options):
    committed = {s: {"g": {"t": {0: s * s}}} for s in range(1, n + 1)}
    ends = {s: {"t": {0: s * s + 5}} for s in range(1, n + 1)}
    return prepare(make.tables(committed, ends), Options(**options))


def test_pairings(make):
    pairs = lambda **o: rows(rates(history(make, 5, **o)), "prev_snapshot_id", "snapshot_id")
    assert pairs() == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert pairs(pairing="disjoint") == [(1, 2), (3, 4)]
    assert pairs(max_pairs=1) == [(1, 2)]
    assert pairs(pairing="disjoint", max_pairs=1) == [(1, 2)]
    assert pairs(max_pairs=0) == []
    assert len(pairs(max_pairs=-1)) == 4


def test_a_poll_that_saw_no_group_separates_its_neighbours(make):
    committed = {1: {"g": {"t": {0: 1}}}, 3: {"g": {"t": {0: 9}}}}
    ends = {s: {"t": {0: 10}} for s in (1, 2, 3)}
    assert rates(prepare(make.tables(committed, ends))).count() == 0


def test_unlisted_snapshot_ids_and_latest_pair(make):
    committed = {s: {"g": {"t": {0: s}}} for s in (10, 17, 400)}
    ends = {s: {"t": {0: 500}} for s in (10, 17, 400)}
    tables = make.tables(committed, ends)
    got = rows(rates(prepare(tables)), "prev_snapshot_id", "snapshot_id", "events_consumed")
    assert got == [(10, 17, 7), (17, 400, 383)]
    last = rates(prepare(tables.latest_pair()))
    assert rows(last, "prev_snapshot_id", "snapshot_id") == [(17, 400)]


def brute_force(committed, ends, dt):
    result = {}
    for s in sorted(committed)[:-1]:
        one, two = committed[s], committed[s + 1]
        asked = [
            {(t, p) for topics in snap.values() for t, parts in topics.items()
             for p, o in parts.items() if o >= 0}
            for snap in (one, two)
        ]
        for g in one:
            for t, parts in one[g].items():
                if t not in two.get(g, {}):
                    continue
                after = two[g][t]
                moved = sum(after[p] if after.get(p, -1) >= 0 else 0 for p, o in parts.items() if o >= 0)
                moved -= sum(o for o in parts.values() if o >= 0)
                arrived = sum(o for p, o in ends[s + 1][t].items() if (t, p) in asked[1])
                arrived -= sum(o for p, o in ends[s][t].items() if (t, p) in asked[0])
                lags = [max(0, ends[s + 1][t][p] - o) for p, o in after.items()
                        if o >= 0 and p in ends[s + 1][t]]
                result[s + 1, g, t] = (moved, arrived / dt, sum(lags) if lags else None)
    return result


@pytest.mark.parametrize("block, chunk", [(64, 4096), (2, 3), (1, 1)])
def test_against_brute_force(make, monkeypatch, block, chunk):
    """Tiny blocks and chunks put every boundary between neighbouring rows."""
    monkeypatch.setattr(ordering, "BLOCK", block)
    monkeypatch.setattr(ordering, "CHUNK", chunk)
    rng = random.Random(11)
    committed, ends = {}, {}
    for s in range(1, 10):
        ends[s] = {t: {p: 100 * s + rng.randrange(50) for p in range(7)} for t in "xy"}
        committed[s] = {
            g: {
                t: {p: rng.choice([-1, 50 * s + rng.randrange(90)]) for p in range(7) if rng.random() < 0.7}
                for t in "xy" if rng.random() < 0.9
            }
            for g in ("g1", "g2") if rng.random() < 0.9
        }
        # A topic without any row cannot be told from an absent one.
        committed[s] = {g: {t: parts for t, parts in topics.items() if parts}
                        for g, topics in committed[s].items()}
    p = prepare(make.tables(committed, ends))
    got = {
        (r.snapshot_id, r.group_id, r.topic): (r.events_consumed, r.arrival_rate, r.lag_sum)
        for r in rates(p).collect()
    }
    assert got == brute_force(committed, ends, 10)
    want = {
        (s, g, t, q): (o - committed[s - 1].get(g, {}).get(t, {}).get(q, -1)) / 10
        if committed.get(s - 1, {}).get(g, {}).get(t, {}).get(q, -1) >= 0 else 0.0
        for s in range(2, 10) for g in committed[s] for t, parts in committed[s][g].items()
        for q, o in parts.items() if o >= 0
    }
    found = {(r.snapshot_id, r.group_id, r.topic, r.partition): r.rate
             for r in partition_history(p).collect()}
    assert found == want


def test_rate_skew(make):
    p = pair(make, {0: 0, 1: 0, 2: 0, 3: 0}, {0: 10, 1: 10, 2: 10, 3: 50})
    (row,) = rate_skew(p).collect()
    assert (row.n_parts, row.rate_par) == (4, 2.5)
    assert row.rate_cv == pytest.approx((3 * 100 + 900) ** 0.5 / 2 / 20)


def test_legacy_rates(make):
    legacy = Options(legacy=True)
    p = pair(make, {0: 40, 1: 83}, {0: 92, 2: 40}, {0: 100, 1: 100}, {0: 200, 2: 100}, 7, legacy)
    (row,) = rates(p).collect()
    assert row.events_consumed == 132 - 123
    assert row.consumption_rate == 1.286  # three decimals
    assert row.arrival_rate == round(100 / 7, 3)
    assert row.remaining_sec == pytest.approx((200 - 92 + 100 - 40) / 1.286)
    assert row.remaining_hms == "0:02:11"


def listed_history(make, listed):
    """Eight polls of two partitions; the last one saw no group."""
    times = {i: 10 * i for i in range(1, 10)}
    committed = {i: {"g": {"t": {0: 10 * i, 1: i * i}}} for i in range(1, 9)}
    ends = {i: {"t": {0: 20 * i, 1: 3 * i * i}} for i in range(1, 10)}
    tables = make.tables(committed, ends, times=times)
    if listed:
        polled = tables.topic_offsets.groupBy("snapshot_id").agg(F.max("captured_at").alias("captured_at"))
        polled = polled.withColumn("snapshot_seq", F.col("snapshot_id") + 100)
        tables = replace(tables, snapshots=polled)
    return tables


@pytest.mark.parametrize("listed", [True, False])
@pytest.mark.parametrize(
    "first,last,options,want",
    [
        (4, 8, Options(max_pairs=2), [5, 6]),
        (2, 3, Options(pairing="disjoint"), [3]),
        (4, 8, Options(pairing="disjoint"), [5, 7]),
        (4, 8, Options(pairing="disjoint", max_pairs=1), [5]),
        (1, 8, Options(max_pairs=0), []),
    ],
)
def test_slices_pair_like_histories(make, listed, first, last, options, want):
    p = prepare(listed_history(make, listed).between(first, last), options)
    assert [r[0] for r in rows(rates(p), "snapshot_id")] == want
    detail = rows(partition_history(p).select("snapshot_id").distinct(), "snapshot_id")
    assert [r[0] for r in detail] == want
    assert sorted({r[0] for r in rows(arrival_rates(p), "snapshot_id")}) == want


@pytest.mark.parametrize("listed", [True, False])
def test_latest_pair_counts_polls_without_groups(make, listed):
    p = prepare(listed_history(make, listed).latest_pair())
    assert rows(rates(p), "snapshot_id") == []
    assert rows(partition_history(p), "snapshot_id") == []
    full = prepare(listed_history(make, listed).between(1, 8).latest_pair())
    assert rows(rates(full), "snapshot_id") == [(8,)]
    assert {r[1] for r in rows(partition_history(full), "snapshot_id", "rate")} == {1.0, 1.5}


def test_poll_missing_from_the_list_is_an_error(make):
    tables = listed_history(make, True)
    short = replace(tables, snapshots=tables.snapshots.filter("snapshot_id <> 3"))
    with pytest.raises(Exception, match="poll 3 is not in the list"):
        rates(prepare(short)).collect()
