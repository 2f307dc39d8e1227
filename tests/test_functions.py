import pytest
from pyspark.sql import functions as F

from tidemark.functions import health, skew, text


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


ETAS = [-1, 0, 59, 60, 119, 120, 599, 600, 7199, 7200]


def test_eta_bands(make):
    df = make.column("bigint", ETAS)
    x = F.col("x")
    assert values(df, health.eta_status(x)["status"]) == (
        ["OK"] * 5 + ["WARNING"] * 2 + ["ERROR"] * 2 + ["CRITICAL"]
    )
    assert values(df, health.eta_status(x)["reason"]) == (
        ["ETA < 1m"] * 3 + ["ETA < 2m"] * 2 + ["ETA > 2m"] * 2 + ["ETA > 10m"] * 2 + ["ETA > 2h"]
    )
    assert values(df, health.eta_level(x)) == (
        ["red"] + ["green"] * 2 + ["yellow"] * 4 + ["magenta"] * 2 + ["red"]
    )
    calm = health.has_issues(x, F.lit(0), F.lit(0.0))
    assert values(df, calm) == [False] * 5 + [True] * 5
    assert values(make.column("bigint", [-2]), health.eta_level(x)) == ["white"]


@pytest.mark.parametrize(
    "arrival, lag, issue",
    [(1.0, 1000, False), (1.1, 0, True), (0.0, 1001, True), (0.0, None, False)],
)
def test_no_consumption(make, arrival, lag, issue):
    df = make.column("bigint", [-1])
    got = health.has_issues(F.col("x"), F.lit(lag).cast("bigint"), F.lit(arrival))
    assert values(df, got) == [issue]


@pytest.mark.parametrize(
    "lag, used, arriving, status, level",
    [
        (5, 0.0, 0.0, "ERROR", "red"),
        (5, 1.0, 2.0, "OK", "green"),
        (5, 1.0, 2.1, "WARNING", "yellow"),
        (5, 1.0, 5.0, "WARNING", "yellow"),
        (5, 1.0, 5.1, "ERROR", "red"),
        (0, 0.0, 1.0, "ERROR", "red"),
        (None, 0.0, 0.0, "OK", "green"),
    ],
)
def test_rate_bands(make, lag, used, arriving, status, level):
    df = make.column("bigint", [lag])
    args = F.col("x"), F.lit(used), F.lit(arriving)
    assert values(df, health.rate_status(*args)["status"]) == [status]
    assert values(df, health.rate_level(*args)) == [level]


def test_rate_reason_differs_in_legacy(make):
    df = make.column("bigint", [5])
    args = F.col("x"), F.lit(0.0), F.lit(0.0)
    assert values(df, health.rate_status(*args)["reason"]) == ["Lag detected but no event consumption"]
    assert values(df, health.rate_status(*args, legacy=True)["reason"]) == [
        "Lag detected but not event consumption"
    ]


def test_cv_levels_and_bands(make):
    df = make.column("double", [0.0, 0.2, 0.49, 0.5, 1.0, 1.01])
    x = F.col("x")
    assert values(df, health.cv_level(x)) == ["none", "green", "green", "yellow", "yellow", "red"]
    assert values(df, skew.cv_band(x)) == (
        ["Excellent"] * 2 + ["Acceptable"] * 2 + ["High skew", "Critical skew"]
    )
    df = make.column("double", [1.0, 1.1, 1.5, 2.0])
    assert values(df, skew.par_band(x)) == ["Balanced", "Safe margin", "Bottleneck", "Severe hotspot"]


def test_diagnosis(make):
    df = make.spark.createDataFrame([(0.1, 1.1), (0.3, 5.0), (0.8, 1.8)], "cv double, par double")
    got = values(df, skew.skew_diagnosis(F.col("cv"), F.col("par")))
    assert got == ["Ideal", "Localized hotspot", "Widespread skew"]


def test_rank_buckets(make):
    df = make.column("bigint", [0, 32, 33, 66, 67, 100])
    got = values(df, health.rank_bucket(F.col("x"), F.lit(0), F.lit(100)))
    assert got == ["low", "low", "mid", "mid", "high", "high"]
    assert values(df, health.rank_bucket(F.col("x"), F.lit(5), F.lit(5))) == ["none"] * 6


def test_state_level(make):
    df = make.column("string", ["EMPTY", "STABLE"])
    assert values(df, health.state_level(F.col("x"))) == ["red", "green"]


def test_hms(make):
    df = make.column("bigint", [-1, 0, 59, 3661, 90061, 9_200_000_000_000_000_000])
    assert values(df, text.hms(F.col("x"))) == [
        "-", "0:00:00", "0:00:59", "1:01:01", "25:01:01", "2555555555555555:33:20"
    ]
    df = make.column("double", [-1.0, 0.5, 1.5, 90061.0, 200000.4])
    assert values(df, text.legacy_hms(F.col("x"))) == [
        "-", "0:00:00", "0:00:02", "1 day, 1:01:01", "2 days, 7:33:20"
    ]


def test_integers_with_units(make):
    numbers = [0, 999, 1000, 12250, 123456, -1500, 999999, 10**18, 1250]
    df = make.column("bigint", numbers)
    assert values(df, text.si_integer(F.col("x"))) == [
        "0", "999", "1.00K", "12.2K", "123K", "-1.50K", "1000K", "1000P", "1.25K"
    ]
    assert values(df, text.si_integer(F.col("x"), plain=True)) == [str(n) for n in numbers]


def test_rates_with_units(make):
    df = make.column("double", [-1.0, 0.0, 2.0, 2.5, 1234.5, 0.25, 999.96])
    assert values(df, text.si_rate(F.col("x"))) == ["-", "0", "2", "2.5", "1.23K", "0.2", "1000.0"]
    assert values(df, text.si_rate(F.col("x"), plain=True))[4] == "1234.5"


def test_rounding_is_that_of_printf(make):
    import random

    rng = random.Random(5)
    numbers = [rng.randrange(1, 10**7) / rng.choice([1, 2, 4, 8, 10, 16, 100]) for _ in range(500)]
    df = make.column("double", numbers)
    for places in (1, 2):
        got = values(df, text.decimals(F.col("x"), places))
        assert got == [f"{n:.{places}f}" for n in numbers]


def test_ratio_text(make):
    assert values(make.column("double", [0.0, 1.005, 2.0]), text.ratio_text(F.col("x"))) == [
        "-", f"{1.005:.2f}", "2.00"
    ]


def test_config_text(make):
    pairs = [
        ("retention.ms", "1209600000", "1209600000 (14 days)"),
        ("x.ms", "5400000", "5400000 (1.5 hours)"),
        ("flush.ms", "60000", "60000 (1.0 min)"),
        ("neg.ms", "-1", "-1 (-0.0 min)"),
        ("max.ms", "9223372036854775807", "9223372036854775807 (106751991167 days)"),
        ("odd.ms", "1.5", "1.5"),
        ("word.ms", "never", "never"),
        ("segment.bytes", "1073741824", "1073741824"),
    ]
    df = make.spark.createDataFrame([p[:2] for p in pairs], "k string, v string")
    assert values(df, text.config_text(F.col("k"), F.col("v"))) == [p[2] for p in pairs]


def test_lists_totals_percent(make):
    df = make.spark.createDataFrame([([1, 2, 3],), (None,), ([],)], "x array<int>")
    assert values(df, text.id_list(F.col("x"))) == ["(1,2,3)", "-", "()"]
    one = make.column("int", [3])
    assert values(one, text.of_total(F.col("x"), F.lit(8))) == ["3/8"]
    assert values(one, text.percent(F.col("x"), F.lit(8))) == [37]
    assert values(one, text.percent(F.col("x"), F.lit(2))) == [100]


def fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_anonymous_names(make):
    names = ["orders", "", "zażółć", "日本", "a" * 300]
    df = make.column("string", names)
    assert values(df, text.fnv1a(F.col("x"))) == [fnv(n.encode()) for n in names]
    assert fnv(b"orders") == 845059820
    assert values(df, text.anonymous("topic", F.col("x")))[0] == "topic 059820"
