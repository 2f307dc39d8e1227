"""Health rules: first matching line wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges of the ETA classes in seconds, and the lag and arrival rate above
# which a group that consumes nothing is an issue.
MINUTE_1, MINUTE_2, MINUTE_10, HOUR_2 = 60, 120, 600, 7200
IDLE_LAG, IDLE_ARRIVAL = 1000, 1.0


def _verdict(status: str, reason: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def eta_status(eta: Column) -> Column:
    """struct(status, reason). An ETA of -1 lies below a minute and so is OK here."""
    return (
        F.when(eta < MINUTE_1, _verdict("OK", "ETA < 1m"))
        .when(eta < MINUTE_2, _verdict("OK", "ETA < 2m"))
        .when(eta < MINUTE_10, _verdict("WARNING", "ETA > 2m"))
        .when(eta < HOUR_2, _verdict("ERROR", "ETA > 10m"))
        .otherwise(_verdict("CRITICAL", "ETA > 2h"))
    )


def _rate_rules(lag: Column, consumption: Column, arrival: Column, results: list) -> Column:
    stuck, far, behind, fine = results
    return (
        F.when((lag > 0) & (consumption == 0), stuck)
        .when(arrival > 5 * consumption, far)
        .when(arrival > 2 * consumption, behind)
        .otherwise(fine)
    )


def rate_status(
    lag: Column, consumption: Column, arrival: Column, legacy: bool = False
) -> Column:
    """struct(status, reason). A lag of NULL counts as none."""
    verb = "not" if legacy else "no"
    return _rate_rules(
        F.coalesce(lag, F.lit(0)),
        consumption,
        arrival,
        [
            _verdict("ERROR", f"Lag detected but {verb} event consumption"),
            _verdict("ERROR", "Arrival rate > 5 * consumption rate"),
            _verdict("WARNING", "Arrival rate > 2 * consumption rate"),
            _verdict("OK", ""),
        ],
    )


def lag_status() -> Column:
    return _verdict("OK", "")


def rate_level(lag: Column, consumption: Column, arrival: Column) -> Column:
    return _rate_rules(
        F.coalesce(lag, F.lit(0)), consumption, arrival, ["red", "red", "yellow", "green"]
    )


def eta_level(eta: Column) -> Column:
    """Colour name of the ETA class; -1 (no end in sight) is red."""
    return (
        F.when(eta == -1, "red")
        .when(eta < 0, "white")
        .when(eta < MINUTE_1, "green")
        .when(eta < MINUTE_10, "yellow")
        .when(eta < HOUR_2, "magenta")
        .otherwise("red")
    )


def has_issues(eta: Column, lag: Column, arrival: Column) -> Column:
    """Two minutes or more to go, or no end in sight while data arrives or waits."""
    return (eta >= MINUTE_2) | (
        (eta == -1) & ((arrival > IDLE_ARRIVAL) | (F.coalesce(lag, F.lit(0)) > IDLE_LAG))
    )


def lag_level() -> Column:
    return F.lit("white")


def state_level(state: Column) -> Column:
    return F.when(state == "EMPTY", "red").otherwise("green")


def cv_level(cv: Column) -> Column:
    return (
        F.when(cv <= 0, "none").when(cv < 0.5, "green").when(cv <= 1.0, "yellow").otherwise("red")
    )


def rank_bucket(value: Column, low: Column, high: Column) -> Column:
    """low / mid / high third of the range; "none" if all values are equal."""
    share = (value - low) / (high - low)
    return F.when(high == low, "none").otherwise(
        F.when(share < 0.33, "low").when(share < 0.67, "mid").otherwise("high")
    )
