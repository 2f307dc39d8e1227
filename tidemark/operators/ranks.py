"""Places in a sort order without sorting the table: an index of counts per range of the order.

The order is cut into at most RANGES ranges by bounds from a sample of its keys. A row's range
follows from its key alone, so nothing has to be stored before rows are numbered: a position is the
count of the ranges before, plus the place inside the range. A page needs the counts and the rows
of the ranges that it touches, and no others. Everything is part of one plan, so that nothing runs
until a result is asked for.

The sample is the key with the least hash of every one of SLOTS hash slots: an aggregate that
combines before the shuffle, at most SLOTS keys whatever the size of the table, and the same in every
run. It only decides how evenly the ranges are filled; counts and positions cover all rows and are
exact for any bounds. Rows with one key cannot be told apart and fall into one range, so an order
should end with columns that make its keys unique.

`Ranking.stored` keeps the rows by range, with their counts, for many questions about one order.
Then a page reads the files of its ranges only, and nothing is computed again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1 << 14
#: Bounds are looked up by halving, so their number is below a power of two.
_STEPS = 10
RANGES = (1 << _STEPS) - 1
_BEFORE = (Window.unboundedPreceding, -1)


def _bounds(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """One row: `bounds`, at most `most` keys in ascending order, evenly spread over the rows."""
    key = F.struct(*keys)
    hashed = F.xxhash64(*keys)
    sample = (
        rows.select(key.alias("key"), hashed.alias("hash"))
        .groupBy(F.pmod("hash", F.lit(SLOTS)).alias("slot"))
        .agg(F.min_by("key", "hash").alias("key"))
    )
    sorted_keys = sample.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    step = F.expr(f"int(ceil((size(keys) + 1) / {most + 1}))")
    spread = F.filter("keys", lambda _, i: (i + 1) % F.col("step") == 0)
    return sorted_keys.withColumn("step", step).select(spread.alias("bounds"))


def _range_of(bounds: Column, key: Column) -> Column:
    """How many bounds are at most the key: `_STEPS` comparisons, whatever their number."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(_STEPS))])

    def halve(low: Column, power: Column) -> Column:
        # Past the last bound `get` gives null, and the comparison fails.
        return F.when(F.get(bounds, low + power - 1) <= key, low + power).otherwise(low)

    return F.aggregate(powers, F.lit(0), halve)


@dataclass(frozen=True)
class Ranking:
    """rows with `_range`, and `counts`: rows of each range (_n), separately for every value of
    `within`. `order` is ascending, or descending in all its columns (`down`)."""

    rows: DataFrame
    counts: DataFrame
    order: tuple[str, ...]
    down: bool
    within: tuple[str, ...]

    @classmethod
    def of(
        cls, rows: DataFrame, order: list[str], down: bool = False, within: list[str] = (), ranges: int = RANGES
    ) -> Ranking:
        """An index of the order over rows. `within` makes positions start anew for each value."""
        if not 0 < ranges <= RANGES:
            raise ValueError(f"ranges must be 1 to {RANGES}")
        bounds = _bounds(rows, list(order), ranges - 1) if ranges > 1 else None
        if bounds is None:
            placed = rows.withColumn("_range", F.lit(0))
        else:
            # One value for the whole plan, of bounded size.
            held = rows.withColumn("_bounds", bounds.scalar())
            placed = held.withColumn("_range", _range_of(F.col("_bounds"), F.struct(*order)))
        placed = placed.drop("_bounds")
        counts = placed.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
        return cls(placed, counts, tuple(order), down, tuple(within))

    def stored(self, folder: str) -> Ranking:
        """The same index, written and read back, a folder for each range. Ask for fewer ranges where
        the table is small."""
        spark = self.rows.sparkSession
        clustered = self.rows.repartitionByRange("_range", *self.within, *self.order)
        clustered.write.partitionBy("_range").parquet(f"{folder}/rows")
        rows = spark.read.schema(self.rows.schema).parquet(f"{folder}/rows")
        rows.groupBy(*self.within, "_range").agg(F.count("*").alias("_n")).coalesce(1).write.parquet(
            f"{folder}/counts"
        )
        return Ranking(rows, spark.read.parquet(f"{folder}/counts"), self.order, self.down, self.within)

    def _sorted(self, *columns: str) -> list[Column]:
        return [F.col(c).desc() if self.down else F.col(c).asc() for c in columns]

    def _before(self, counts: DataFrame, within: tuple[str, ...]) -> DataFrame:
        """counts with `_before`: the rows in the ranges that come first in the order."""
        upto = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*self._sorted("_range"))
        before = F.sum("_n").over(upto.rowsBetween(*_BEFORE))  # at most RANGES rows a window
        return counts.withColumn("_before", F.coalesce(before, F.lit(0)))

    def _inside(self, *within: str) -> Column:
        """Place of a row in its range, from 1."""
        window = Window.partitionBy(*within, "_range").orderBy(*self._sorted(*self.order))
        return F.row_number().over(window)

    def positions(self, out: str = "position") -> DataFrame:
        """All rows with their position, from 1."""
        counts = self._before(self.counts, self.within).drop("_n")
        # A null in `within` is a value like others.
        named = counts.select(F.col("_range").alias("_of"), "_before", *[F.col(c).alias(f"_of_{c}") for c in self.within])
        rows = self.rows.withColumn(out, self._inside(*self.within))
        same = F.col("_range") == F.col("_of")
        for c in self.within:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        placed = rows.join(named, same).withColumn(out, F.col(out) + F.col("_before"))
        return placed.drop("_range", "_before", *[c for c in named.columns if c.startswith("_of")])

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows offset .. offset + size - 1 of the whole order, `within` or not, in it, with
        `position` and the number of all rows, `total`. An offset beyond the end gives the last row.
        """
        counts = self.counts.groupBy("_range").agg(F.sum("_n").alias("_n"))
        counts = self._before(counts, ()).withColumn("total", F.sum("_n").over(Window.partitionBy(F.lit(0))))
        start = F.greatest(F.lit(0), F.least(F.lit(offset), F.col("total") - 1))
        touched = counts.withColumn("_start", start).filter(
            (F.col("_before") < F.col("_start") + size) & (F.col("_before") + F.col("_n") > F.col("_start"))
        )
        # At most RANGES rows. Where rows are stored by range, the join prunes their folders.
        rows = self.rows.join(F.broadcast(touched.drop("_n")), "_range")
        shown = (F.col("position") > F.col("_start")) & (F.col("position") <= F.col("_start") + size)
        found = rows.withColumn("position", self._inside() + F.col("_before")).filter(shown)
        return found.orderBy("position").drop("_range", "_before", "_start")
