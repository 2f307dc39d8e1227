"""Mixing sources to target weights, in DataFrame functions only.

Every document has a hash-random key. Within a source the documents are ordered by it, prefix
sums of their sizes are taken, and the source is cut at its budget; a budget above the source's
size repeats the source. The order is cut into key ranges first: sums per range are prefix-summed
(at most 2**MOST_BITS a source), and each range is summed on its own, so a source of any size
is spread over all tasks.

Sizes are words; null text has none. A null source is a source of its own, the last one. Rows
with one id are ordered by size, and equal rows may swap their shares. Whole documents
(`mixed_documents`) are ordered by id and text. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import fixed, word_count
from tidemark.session import broadcast_if_small

KEY_BITS = 60
MOST_BITS = 14
RANGE_ROWS = 256
WEIGHTS = (3, 1, 2)
MOST_BROADCAST = 100_000


def random_key(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of the md5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of every row, computed once: texts are read once."""
    return fixed(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            random_key(F.col("doc_id")).alias("key"),
        )
    )


def targets(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """source, source_size, target: `share` of all sizes dealt by weight (the sources take the
    weights in turn, by code point, null last). No target exceeds `cap` times its source's
    size; what is above goes to the others by weight until none is above.

    Sources in the order of cap / weight: the first whose part of what is left does not exceed
    its cap sets the level for itself and all later ones. The windows see one row a source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = (
        sources.withColumn("turn", turn)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1))
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("total", share * F.sum("source_size").over(everything))
    )
    order = everything.orderBy(F.col("most") / F.col("weight"), "turn")
    before, rest = (order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = weighed.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    below = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    chosen = ranked.withColumn("chosen", F.min(below).over(everything))
    uncapped = F.col("place") >= F.col("chosen.place")
    target = F.when(uncapped, F.col("chosen.level") * F.col("weight")).otherwise(F.col("most"))
    return chosen.select("source", "source_size", target.alias("target"))


def with_budget(goals: DataFrame) -> DataFrame:
    """Adds `epochs`, the times the whole source is taken, and `rest`, the words taken from the
    start of the order in the last epoch."""
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size"))
    return goals.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long")).withColumn(
        "rest", budget - F.col("epochs") * F.col("source_size")
    )


def with_before(rows: DataFrame, bits: int) -> DataFrame:
    """Adds `before`, the sum of sizes of the earlier rows of the source in key order."""
    ranged = rows.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = (
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sums.select(
        F.col("source").alias("s"),
        F.col("range").alias("r"),
        F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start"),
    )
    inside = (
        Window.partitionBy("source", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = numbered.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return joined.withColumn("before", F.col("start") + F.col("inside")).select(*rows.columns, "before")


def range_bits(n: int) -> int:
    """Key bits that name a range: about RANGE_ROWS rows each, 2**MOST_BITS ranges at most."""
    return min(MOST_BITS, max(1, math.ceil(math.log2(max(2, n) / RANGE_ROWS)))) if n > RANGE_ROWS else 1


def mixed(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows of `sized` with source_size, target and taken, the words the mix takes."""
    goals = with_budget(goals).withColumnRenamed("source", "of")
    small = broadcast_if_small(goals, MOST_BROADCAST)
    prefix = with_before(rows, range_bits(rows.count()))
    joined = prefix.join(small, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    last = F.greatest(F.lit(0), F.least(F.col("rest") - F.col("before"), F.col("size")))
    return joined.withColumn("taken", F.col("epochs") * F.col("size") + last)


def document_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """Hash-random key of a document by its id and text: rows without an id, or with one id, have
    keys of their own unless their texts are equal too."""
    named = F.coalesce(doc_id.cast("string"), F.lit(""))
    of = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), named, of)), 1, KEY_BITS // 4), 16, 10).cast("long")


def places(docs: DataFrame) -> DataFrame:
    """source, key, n (rows), size (words of all) and unit (words of one row), computed once. Rows of
    one key are one place, so that copies of a text make no hot key."""
    keyed = docs.select(
        "source", document_key(docs["doc_id"], docs["text"]).alias("key"), word_count(docs["text"]).alias("unit")
    )
    counted = keyed.groupBy("source", "key").agg(
        F.count("*").alias("n"), F.sum("unit").alias("size"), F.max("unit").alias("unit")
    )
    return fixed(counted.withColumn("doc_id", F.lit(None).cast("long")))


def mixed_documents(docs: DataFrame, rows: DataFrame, goals: DataFrame) -> DataFrame:
    """The documents of the mix, whole: each once for every epoch that takes it; rows are those of
    `places`. In the last epoch the row at the cut is in if at least half of it is within the
    budget, so a source misses its target by half a document at most.

    Rows below the cut are decided where they are, with one row a source; texts are not
    shuffled. Only where the cut falls among rows of one id and text are these counted, by all
    their columns, and as many of them taken as fit.
    """
    goals = with_budget(goals).withColumnRenamed("source", "of")
    prefix = with_before(rows, range_bits(rows.count()))
    joined = prefix.join(broadcast_if_small(goals, MOST_BROADCAST), F.col("source").eqNullSafe(F.col("of")))
    part = F.greatest(F.lit(0), F.least(F.col("rest") - F.col("before"), F.col("size")))
    fit = F.when(F.col("unit") > 0, F.expr("(2 * part + unit) div (2 * unit)")).otherwise(
        F.when(F.col("before") < F.col("rest"), F.col("n")).otherwise(0)
    )
    cuts = (
        joined.withColumn("part", part).withColumn("fit", fit)
        .groupBy(F.col("source").alias("_mix_source"))
        .agg(
            F.first("epochs").alias("_mix_epochs"),
            F.max(F.when(F.col("fit") == F.col("n"), F.col("key"))).alias("_mix_cut"),
            # Whole places lie before the cut, so at most one is taken in part.
            F.max(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("n")), F.struct("key", "fit"))).alias("_mix_tie"),
        )
    )
    cuts = fixed(cuts)
    small = broadcast_if_small(cuts, MOST_BROADCAST)
    key = document_key(docs["doc_id"], docs["text"])
    joined = docs.join(small, docs["source"].eqNullSafe(small["_mix_source"])).withColumn("_mix_key", key)
    tied = F.coalesce(F.col("_mix_key") == F.col("_mix_tie.key"), F.lit(False))
    once_more = F.coalesce((F.col("_mix_key") <= F.col("_mix_cut")).cast("long"), F.lit(0))
    taken = _repeated(joined.filter(~tied), F.col("_mix_epochs") + once_more, docs.columns)
    if cuts.filter("_mix_tie is not null").isEmpty():
        return taken
    variants = joined.filter(tied).groupBy(*docs.columns, "_mix_epochs", "_mix_tie").agg(F.count("*").alias("_mix_n"))
    before = (
        Window.partitionBy("source").orderBy(F.xxhash64(*docs.columns))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = F.coalesce(F.sum("_mix_n").over(before), F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("_mix_tie.fit") - earlier, F.col("_mix_n")))
    return taken.union(_repeated(variants, F.col("_mix_epochs") * F.col("_mix_n") + rest, docs.columns))


def _repeated(rows: DataFrame, times: Column, columns: list[str]) -> DataFrame:
    copies = rows.withColumn("_mix_times", times.cast("int")).filter("_mix_times > 0")
    return copies.withColumn("_mix_time", F.explode(F.expr("sequence(1, _mix_times)"))).select(*columns)
