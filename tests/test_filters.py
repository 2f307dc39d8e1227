import pytest
from conftest import rows

from tidemark import Options
from tidemark.operators.clean import live_groups, prepare, topic_groups, with_state
from tidemark.operators.rates import arrival_rates

STATES = [
    ("a", "Stable", 1, False, "STABLE"),
    ("b", "Empty", 0, False, "EMPTY"),
    ("c", "PreparingRebalance", 1, False, "PREPARING_REBALANCE"),
    ("d", "CompletingRebalance", 1, False, "COMPLETING_REBALANCE"),
    ("e", "Dead", 0, False, "DEAD"),
    ("f", "Assigning", 2, False, "STABLE"),
    ("g", "", 0, False, "EMPTY"),
    ("h", "Empty", 0, True, "STABLE"),
    ("i", None, None, None, "EMPTY"),
]


def group(g, raw="Stable", members=1, failed=False, s=1):
    return dict(snapshot_id=s, group_id=g, raw_state=raw, member_count=members, describe_failed=failed)


def test_states(make):
    df = make.frame("groups", [group(g, r, m, f) for g, r, m, f, _ in STATES])
    assert rows(with_state(df), "group_id", "state") == [(s[0], s[4]) for s in STATES]


def test_duplicate_groups_count_once(make):
    df = make.frame("groups", [group("a"), group("a")])
    assert with_state(df).count() == 1


def three(make, **kw):
    topics = {"t": {0: 1}}
    return make.tables({1: {"abc-7": topics, "xabc": topics, "b": topics}}, {1: {"t": {0: 5}}}, **kw)


def test_patterns_search_anywhere(make):
    kept = topic_groups(prepare(three(make), Options(include="b", exclude="^x")))
    assert rows(kept, "group_id") == [("abc-7",), ("b",)]
    assert topic_groups(prepare(three(make), Options(include="", exclude=""))).count() == 3


@pytest.mark.parametrize("field", ["include", "exclude", "group_filter", "topic_filter"])
def test_bad_pattern_is_refused_at_once(field):
    with pytest.raises(ValueError, match="invalid pattern"):
        Options(**{field: "("})


def test_bad_choices_are_refused():
    with pytest.raises(ValueError):
        Options(eta_method="fast")
    with pytest.raises(ValueError):
        Options(pairing="random")


def test_empty_groups_are_hidden_unless_asked_for(make):
    groups = [group("abc-7"), group("xabc", "Empty", 0), group("ghost", "Empty", 0)]
    tables = three(make, groups=groups)
    # "b" is not listed at all, so its offsets are not looked at.
    assert rows(topic_groups(prepare(tables)), "group_id") == [("abc-7",)]
    shown = prepare(tables, Options(show_empty=True))
    assert rows(topic_groups(shown), "group_id") == [("abc-7",), ("xabc",)]
    assert rows(live_groups(tables.groups, Options()), "group_id") == [("abc-7",)]


def test_group_filter_shrinks_arrival(make):
    committed = {s: {"left": {"t": {0: 1}}, "right": {"t": {1: 1}}} for s in (1, 2)}
    ends = {1: {"t": {0: 10, 1: 100}}, 2: {"t": {0: 30, 1: 500}}}
    tables = make.tables(committed, ends)
    every = arrival_rates(prepare(tables))
    assert rows(every, "events_arrived", "arrival_rate") == [(420, 42.0)]
    left = arrival_rates(prepare(tables, Options(include="left")))
    assert rows(left, "events_arrived", "arrival_rate") == [(20, 2.0)]
