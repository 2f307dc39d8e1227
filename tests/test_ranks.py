"""Positions and pages from counts per range, against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranks import SLOTS, Ranking
from tidemark.plans import reports

SCHEMA = "g int, v double, name string, extra int"


def table(spark, n, seed=3):
    rng = random.Random(seed)
    values = [0.0, -0.0, 1.5, float("inf"), float("nan"), None]
    rows = [
        (rng.choice([None, 1, 2, 3]), rng.choice([*values, rng.random()]), f"n{k}", k) for k in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def in_order(df, down):
    order = [F.col(c).desc() if down else F.col(c).asc() for c in ("v", "name")]
    return [r.extra for r in df.coalesce(1).sortWithinPartitions(*order).collect()]


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("ranges", [1, 2, 7, 1023])
def test_positions_equal_a_sort(spark, down, ranges):
    df = table(spark, 900)
    index = Ranking.of(df.repartition(5), ["v", "name"], down, ["g"], ranges)
    got = index.positions().collect()
    assert len(got) == 900
    for g in (1, 2, 3):
        own = sorted((r.position, r.extra) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert [x for _, x in own] == in_order(df.filter(F.col("g") == g), down)


def test_no_rows_and_one_key(spark):
    none = Ranking.of(table(spark, 5).filter("false"), ["name"])
    assert none.positions().count() == 0 and none.page(0, 3).count() == 0
    same = spark.createDataFrame([(1, 1.0, "a", k) for k in range(40)], SCHEMA)
    places = [r.position for r in Ranking.of(same, ["v", "name"]).positions().collect()]
    assert sorted(places) == list(range(1, 41))
    with pytest.raises(ValueError):
        Ranking.of(same, ["v"], ranges=0)


def test_ranges_are_filled_evenly_whatever_the_values(spark):
    """A value that nine tenths of the rows share is cut by the columns behind it."""
    rows = spark.range(60000).selectExpr("if(id % 10 = 0, id, 0) as v", "cast(id as string) as name")
    sizes = [r._n for r in Ranking.of(rows, ["v", "name"], ranges=64).counts.collect()]
    assert sum(sizes) == 60000 and len(sizes) == 64 and max(sizes) < 2 * 60000 / 64
    assert SLOTS < 60000  # the bounds came from a sample


def test_stored_pages_read_their_ranges(spark, tmp_path):
    df = table(spark, 600)
    index = Ranking.of(df, ["v", "name"], True, ["g"], 12)
    kept = index.stored(str(tmp_path / "index"))
    whole = in_order(df, True)
    for offset, size in ((0, 5), (290, 30), (598, 9), (5000, 4)):
        start = min(offset, 599)
        for found in (index.page(offset, size), kept.page(offset, size)):
            assert [r.extra for r in found.collect()] == whole[start : start + size]
    page = kept.page(290, 5)
    page.collect()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    numbered = {r.extra: r.position for r in kept.positions().collect()}
    assert numbered == {r.extra: r.position for r in index.positions().collect()}


def test_building_runs_no_job(spark):
    """Positions, pages and searches are plans: nothing is computed or written before an action."""
    names = ("shown_group", "shown_topic")
    rows = spark.range(50).selectExpr(
        "1L as snapshot_id", "concat('g', id) as group_id", "'t' as topic", "id % 3 as lag"
    )
    rows = rows.withColumns({n: F.col("group_id") for n in names})
    spark.sparkContext.setJobGroup("building", "no job may run here")
    reports.number_report(rows, "lag")
    reports.page(rows, 20, 5, "lag")
    found = reports.search_report(rows, "G1", "lag")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    assert found.count() == 11


def test_one_stored_ranking_serves_all_questions(spark, tmp_path):
    rows = spark.range(200).selectExpr(
        "id % 2 as snapshot_id", "concat('g', id div 2) as group_id", "'t' as topic", "id % 5 as lag"
    )
    rows = rows.withColumns({n: F.col("group_id") for n in ("shown_group", "shown_topic")})
    kept = reports.ranking(rows, "lag").stored(str(tmp_path / "ranking"))
    as_set = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert as_set(reports.number_report(kept)) == as_set(reports.number_report(rows, "lag"))
    assert as_set(reports.search_report(kept, "G7")) == as_set(reports.search_report(rows, "G7", "lag"))
    got, want = reports.page(kept, 77, 9), reports.page(rows, 77, 9, "lag")
    assert got.collect() == want.select(got.columns).collect()
    order = [F.col(c).desc() for c in ("lag", "group_id", "topic")]
    expected = rows.orderBy(*order, "snapshot_id").collect()[77:86]
    assert [(r.group_id, r.snapshot_id) for r in got.collect()] == [(r.group_id, r.snapshot_id) for r in expected]
