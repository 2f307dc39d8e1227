"""The documented skew measure: spread of partition consumption rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clean import Prepared
from tidemark.operators.lag import spread
from tidemark.operators.rates import partition_rates


def rate_skew(prepared: Prepared) -> DataFrame:
    """PAR and Cv of the partitions' consumption rates per pair, group and topic.

    Every partition of a pair has the same time difference, so the ratios are those of the
    consumed counts, which are integers: exact sums, combined before the shuffle.
    """
    moved = (F.col("committed_offset") - F.col("prev_offset")).cast("bigint")
    wide = moved.cast("decimal(38,0)")
    return (
        partition_rates(prepared)
        .groupBy("snapshot_id", "prev_snapshot_id", "group_id", "topic")
        .agg(
            F.count("*").alias("n_parts"),
            F.max(moved).alias("peak"),
            F.sum(moved).alias("total"),
            F.sum(wide * wide).cast("decimal(38,0)").alias("squares"),
        )
        .select(
            "snapshot_id",
            "prev_snapshot_id",
            "group_id",
            "topic",
            "n_parts",
            F.when(
                F.col("total") > 0,
                F.col("peak") / (F.col("total").cast("double") / F.col("n_parts")),
            )
            .otherwise(0.0)
            .alias("rate_par"),
            spread("n_parts", "total", "squares").alias("rate_cv"),
        )
    )
