"""Partition lag and its statistics per (snapshot, group, topic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.clean import Prepared, topic_groups
from tidemark.operators.ordering import exact_middle
from tidemark.session import fixed

_WIDE = "decimal(38,0)"


def lag_value(legacy: bool) -> Column:
    """End minus committed. The two are captured at different moments, so a small negative
    difference means "no lag"; the legacy tool kept it."""
    lag = F.col("end_offset") - F.col("committed_offset")
    return lag if legacy else F.greatest(lag, F.lit(0).cast("bigint"))


def partition_lag(prepared: Prepared) -> DataFrame:
    """Lag of each partition that has both a committed and an end offset.

    An equi-join whose right side has one row per key. A topic that very many groups read
    makes its key hot on the left only, which AQE splits.
    """
    ends = prepared.end_offsets
    if prepared.options.legacy:
        ends = ends.join(prepared.requested, S.PARTITION_KEY, "left_semi")
    return prepared.offsets.join(ends, S.JOIN_KEY).select(
        *S.STATS_KEY,
        "partition",
        "committed_offset",
        "end_offset",
        lag_value(prepared.options.legacy).alias("lag"),
    )


def stat_columns(lag: str = "lag") -> list[Column]:
    """Mergeable sums: each combines before the shuffle, whatever the group size. Squares
    are exact decimals, so the spread does not depend on the order of the rows."""
    wide = F.col(lag).cast(_WIDE)
    return [
        F.count(lag).alias("n_parts"),
        F.min(lag).alias("lag_min"),
        F.max(lag).alias("lag_max"),
        F.sum(lag).alias("lag_sum"),
        F.sum(wide * wide).cast(_WIDE).alias("lag_sq"),
    ]


def counted_columns(n: str, lag: str = "lag") -> list[Column]:
    """The same from distinct values and the number of rows that have them."""
    wide, times = F.col(lag).cast(_WIDE), F.col(n)
    return [
        F.sum(times).alias("n_parts"),
        F.min(lag).alias("lag_min"),
        F.max(lag).alias("lag_max"),
        F.sum(F.col(lag) * times).alias("lag_sum"),
        F.sum((wide * wide).cast(_WIDE) * times.cast(_WIDE)).cast(_WIDE).alias("lag_sq"),
    ]


def merge_columns() -> list[Column]:
    return [
        F.sum("n_parts").alias("n_parts"),
        F.min("lag_min").alias("lag_min"),
        F.max("lag_max").alias("lag_max"),
        F.sum("lag_sum").alias("lag_sum"),
        F.sum("lag_sq").cast(_WIDE).alias("lag_sq"),
    ]


def spread(n: str, total: str, squares: str) -> Column:
    """Population standard deviation over mean, as sqrt(n*S2 - S1*S1) / S1: exact until the
    square root. Where even 38 digits do not hold n*S2, floating point has to do."""
    count, sum1, sum2 = F.col(n).cast("decimal(20,0)"), F.col(total).cast(_WIDE), F.col(squares)
    exact = F.try_subtract(F.try_multiply(count, sum2), sum1 * sum1).cast("double")
    as_double = F.col(n).cast("double") * sum2.cast("double") - F.pow(sum1.cast("double"), 2)
    value = F.sqrt(F.coalesce(exact, F.greatest(as_double, F.lit(0.0)))) / F.col(total)
    return F.when(F.col(total) > 0, value).otherwise(0.0)


def with_shape(df: DataFrame) -> DataFrame:
    """Mean, peak-to-average ratio and coefficient of variation from the sums."""
    mean = F.col("lag_sum").cast("double") / F.col("n_parts")
    return (
        df.withColumn("lag_mean", F.when(F.col("n_parts") > 0, mean))
        .withColumn(
            "par",
            F.when(F.col("lag_sum") > 0, F.col("lag_max") / F.col("lag_mean")).otherwise(0.0),
        )
        .withColumn("cv", spread("n_parts", "lag_sum", "lag_sq"))
        .drop("lag_sq")
    )


def _halfway(low: str, high: str, legacy: bool) -> Column:
    """Mean of two values; cut to an integer, except in the legacy results. Without the
    legacy flag both are >= 0."""
    return F.expr(f"({low} + {high}) / 2" if legacy else f"{low} + ({high} - {low}) div 2")


def _with_median(lags: DataFrame, legacy: bool) -> DataFrame:
    """Statistics and the median of the collected values."""
    v = F.sort_array(F.collect_list("lag"))
    stats = lags.groupBy(*S.STATS_KEY).agg(*stat_columns(), v.alias("v"))
    low, high = "v[cast((n_parts - 1) div 2 as int)]", "v[cast(n_parts div 2 as int)]"
    median = F.when(F.col("n_parts") > 0, _halfway(low, high, legacy))
    return stats.withColumn("lag_median", median).drop("v")


def _wide_median(lags: DataFrame, wide: DataFrame, legacy: bool) -> DataFrame:
    """The same where some topics are too wide to collect: their median and their statistics come from
    the number of partitions that have a value. Those numbers are computed once."""
    topic = ["snapshot_id", "topic"]
    narrow = _with_median(lags.join(wide, topic, "left_anti"), legacy)
    of_wide = lags.join(wide, topic, "left_semi")
    counted = fixed(of_wide.groupBy(*S.STATS_KEY, "lag").agg(F.count("*").alias("n")))
    middle = exact_middle(counted, S.STATS_KEY, "lag", "n").select(
        *S.STATS_KEY, _halfway("low", "high", legacy).alias("lag_median")
    )
    stats = counted.groupBy(*S.STATS_KEY).agg(*counted_columns("n"))
    return narrow.unionByName(stats.join(middle, S.STATS_KEY))


def lag_stats(prepared: Prepared, median: bool = True) -> DataFrame:
    """One row per snapshot, group and topic that has at least one lag.

    Without the median every statistic is a mergeable aggregate. The median needs the
    values: they are collected for topics of at most CHUNK partitions. Wider topics go
    through `exact_middle`, which collects nothing.
    """
    lags = partition_lag(prepared)
    legacy = prepared.options.legacy
    if not median:
        stats = lags.groupBy(*S.STATS_KEY).agg(*stat_columns())
    elif prepared.is_narrow():
        stats = _with_median(lags, legacy)
    else:
        stats = _wide_median(lags, prepared.wide_topics(), legacy)
    if legacy:
        # A topic without any lag still has a row, of zeros.
        stats = topic_groups(prepared).join(stats, S.STATS_KEY, "left").na.fill(0)
        stats = stats.withColumn("lag_sq", F.coalesce("lag_sq", F.lit(0).cast(_WIDE)))
    return with_shape(stats).select(
        *S.STATS_KEY,
        "n_parts",
        "lag_min",
        "lag_max",
        "lag_sum",
        "lag_mean",
        *(["lag_median"] if median else []),
        "par",
        "cv",
    )
