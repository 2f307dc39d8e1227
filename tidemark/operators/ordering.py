"""Order-dependent building blocks that never gather a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import fixed

# 21 bits per level: no window below holds more than 2**22 rows, for any bigint.
_DIGIT = 21

# Snapshots per block. A history is cut into blocks of this many consecutive snapshots;
# one row in BLOCK is sent to two blocks so that every neighbouring pair meets.
BLOCK = 64

# Partition ids per chunk. (snapshot, group, topic, partition) is unique, so a chunk of a
# topic has at most CHUNK rows per snapshot, and BLOCK + 1 snapshots of it fit one task.
CHUNK = 4096


def dense_sequence(ids: DataFrame, column: str, out: str) -> DataFrame:
    """Number distinct bigints 0, 1, 2, ... in their order.

    Counts are summed over two coarser levels first, so each window sees one level of one
    bucket only and the numbering is spread over the buckets.
    """
    middle, top = F.shiftright(column, _DIGIT), F.shiftright(column, 2 * _DIGIT)
    before = (Window.unboundedPreceding, -1)
    leaves = ids.withColumn("_m", middle).withColumn("_t", top)
    middles = leaves.groupBy("_t", "_m").agg(F.count("*").alias("_n"))
    tops = (
        middles.groupBy("_t")
        .agg(F.sum("_n").alias("_n"))
        .select(
            "_t",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(F.lit(0)).orderBy("_t").rowsBetween(*before)
                ),
                F.lit(0),
            ).alias("_t0"),
        )
    )
    starts = middles.join(tops, "_t").select(
        "_t",
        "_m",
        (
            F.col("_t0")
            + F.coalesce(
                F.sum("_n").over(Window.partitionBy("_t").orderBy("_m").rowsBetween(*before)),
                F.lit(0),
            )
        ).alias("_m0"),
    )
    rank = F.row_number().over(Window.partitionBy("_t", "_m").orderBy(column)) - 1
    return (
        leaves.join(starts, ["_t", "_m"])
        .withColumn(out, F.col("_m0") + rank)
        .drop("_t", "_m", "_m0")
    )


def blocked(df: DataFrame, seq: str = "snapshot_seq", towards: str = "next") -> DataFrame:
    """Add `block`, repeating each edge row in the neighbouring block.

    towards="next": a row meets its successor, so a block also gets the first row of the
    following block; towards="previous": the mirror image.
    """
    home = F.expr(f"{seq} div {BLOCK}")
    edge, other = (0, home - 1) if towards == "next" else (BLOCK - 1, home + 1)
    blocks = F.when(F.col(seq) % BLOCK == edge, F.array(home, other)).otherwise(F.array(home))
    return df.withColumn("block", F.explode(blocks))


def in_home_block(seq: str = "snapshot_seq") -> Column:
    """True for a row in the block it belongs to, false for its repeated copy."""
    return F.expr(f"{seq} div {BLOCK}") == F.col("block")


def with_chunk(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk", F.expr(f"partition div {CHUNK}"))


def with_position(
    df: DataFrame, order: list[Column], within: list[str], out: str = "position"
) -> DataFrame:
    """Row position (from 1) in the order `order`, counted separately for each `within`.

    One distributed sort; the sorted rows are fixed with a reliable checkpoint, because
    they are read twice and both readings must see the same numbering. What is added per
    row is the number of rows of its group in earlier sort ranges.
    """
    ranged = fixed(
        df.orderBy(*within, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_id", 33))
    )
    extents = ranged.groupBy("_range", *within).agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    )
    earlier = (
        Window.partitionBy(*(within or [F.lit(0)]))  # at most one row per sort range
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    extents = extents.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # A group of rows can span many ranges and a range can hold many groups; the pair is
    # the key, so neither is gathered anywhere.
    return (
        ranged.join(extents.drop("_n"), ["_range", *within])
        .withColumn(out, F.col("_id") - F.col("_first") + F.col("_before") + 1)
        .select(*df.columns, out)
    )


def exact_middle(values: DataFrame, keys: list[str], value: str, count: str | None = None) -> DataFrame:
    """The two middle values of a bigint column per key (`low`, `high`; equal if the count
    is odd), for groups of any size. `count` is the number of times that a row's value counts.

    The two middle ranks are followed digit by digit, from the high 21 bits to the low
    ones; each step looks at counts per digit only, so no group's values come together.
    """
    times = F.sum(count) if count else F.count("*")
    counted = values.groupBy(*keys, value).agg(times.alias("_c"))
    total = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    live = counted.join(
        total.select(
            *keys,
            F.explode(F.expr("array_distinct(array((_n - 1) div 2, _n div 2))")).alias("_rank"),
        ).withColumn("_start", F.col("_rank")),
        keys,
    )
    ident = [*keys, "_start"]
    for shift in (2 * _DIGIT, _DIGIT, 0):
        digit = F.shiftright(value, shift)
        if shift < 2 * _DIGIT:  # the highest digit keeps its sign
            digit = digit.bitwiseAND(F.lit((1 << _DIGIT) - 1))
        live = live.withColumn("_d", digit)
        upto = Window.partitionBy(*ident).orderBy("_d").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        chosen = (
            live.groupBy(*ident, "_d")
            .agg(F.sum("_c").alias("_dc"), F.max("_rank").alias("_rank"))
            .withColumn("_hi", F.sum("_dc").over(upto))
            .filter("_rank < _hi and _rank >= _hi - _dc")
            .select(*ident, "_d", F.expr("_rank - (_hi - _dc)").alias("_rank"))
        )
        live = live.drop("_rank").join(chosen, [*ident, "_d"]).drop("_d")
    # Only the value at each rank is left.
    return live.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
