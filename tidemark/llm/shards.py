"""Sharding by fixed virtual slots.

A record belongs to one of SLOTS slots by the hash of its id, for good. What changes is the map
from slots to shards: it has a version, is stored as a small table, and is edited when shards
have grown apart or when shards are added. Records move only with their slot.

Deciding needs the bytes of each slot only, at most SLOTS rows whatever the data's size.

`current_map` is the rule for a folder of stored versions: the newest one as it is while its shards
are near equal, the next version, stored beside it, once they have grown apart. A version is written
to a folder of its own and is never changed, so readers of an older one are not disturbed.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192


def virtual_slot(doc_id: Column, text: Column) -> Column:
    """Slot of a record: by its id, or by its text where the id is null. Rows with one id share
    a slot."""
    key = F.coalesce(_hashed(doc_id), _hashed(text), F.lit(0).cast("long"))
    return F.pmod(key, F.lit(SLOTS)).cast("int")


def _hashed(column: Column) -> Column:
    return F.when(column.isNotNull(), F.xxhash64(column))


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard: np.ndarray  # of each slot

    def loads(self, bytes_of: np.ndarray) -> np.ndarray:
        return np.bincount(self.shard, bytes_of, self.shards)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s, int(x)) for s, x in enumerate(self.shard)]
        return spark.createDataFrame(rows, "slot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Write this version beside the others; an existing version is never changed."""
        named = self.frame(spark).withColumn("shards", F.lit(self.shards))
        named.coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @classmethod
    def versions(cls, spark: SparkSession, folder: str) -> list[int]:
        """The stored versions, oldest first; none if nothing has been stored there."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
        # A version without its mark was never finished.
        found = files.globStatus(done) if files.exists(path) else []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version, or the newest."""
        stored = spark.read.parquet(folder)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        rows = stored.filter(F.col("version") == version).orderBy("slot").collect()
        return cls(version, rows[0].shards, np.array([r.shard for r in rows]))


def slot_bytes(docs: DataFrame) -> np.ndarray:
    """Bytes of each slot; one aggregate, combined before the shuffle."""
    slot = virtual_slot(F.col("doc_id"), F.col("text")).alias("slot")
    return measured(docs.select(slot, record_bytes(F.col("text")).alias("bytes")))


def measured(rows: DataFrame) -> np.ndarray:
    out = np.zeros(SLOTS, np.int64)
    for r in rows.groupBy("slot").agg(F.sum("bytes").alias("bytes")).collect():  # <= SLOTS rows
        out[r.slot] = r.bytes
    return out


def first_map(bytes_of: np.ndarray, shards: int) -> SlotMap:
    """Largest slot first, each to the lightest shard so far; ties by slot and shard number.
    Empty slots are dealt in turn."""
    shard = np.arange(len(bytes_of)) % shards
    _deal(shard, np.flatnonzero(bytes_of), bytes_of, np.zeros(shards, np.int64))
    return SlotMap(1, shards, shard)


def _deal(shard: np.ndarray, slots: np.ndarray, bytes_of: np.ndarray, loads: np.ndarray) -> None:
    heap = [(int(x), i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for s in slots[np.argsort(-bytes_of[slots], kind="stable")]:
        load, i = heapq.heappop(heap)
        shard[s] = i
        heapq.heappush(heap, (load + int(bytes_of[s]), i))


def rebalanced(old: SlotMap, bytes_of: np.ndarray, tolerance: float = 0.01) -> SlotMap:
    """The next version: shards more than `tolerance` above the mean give up slots, the
    smallest that suffice first from the largest down, which go to the lightest shards. The
    same version comes back if nothing is out of bounds."""
    loads = old.loads(bytes_of)
    bound = loads.mean() * (1 + tolerance)
    given = []
    for i in np.flatnonzero(loads > bound):
        own = np.flatnonzero((old.shard == i) & (bytes_of > 0))
        for s in own[np.argsort(-bytes_of[own], kind="stable")]:
            if loads[i] - bytes_of[s] >= loads.mean() * (1 - tolerance):
                loads[i] -= bytes_of[s]
                given.append(s)
            if loads[i] <= bound:
                break
    if not given:
        return old
    shard = old.shard.copy()
    _deal(shard, np.array(given), bytes_of, loads.astype(np.int64))
    return replace(old, version=old.version + 1, shard=shard)


def current_map(
    spark: SparkSession, folder: str, bytes_of: np.ndarray, shards: int, tolerance: float = 0.01
) -> SlotMap:
    """The map to use for these bytes a slot: the newest stored version, read back from the folder.

    Without one, the first map is stored; if shards are more than `tolerance` above the mean, a
    rebalanced version; if more shards are asked for, a grown one. Fewer shards are an error.
    """
    stored = SlotMap.versions(spark, folder)
    if not stored:
        made = first_map(bytes_of, shards)
    else:
        made = SlotMap.load(spark, folder, stored[-1])
        if made.shards > shards:
            raise ValueError(f"the map in {folder} has {made.shards} shards, not {shards}")
        if made.shards < shards:
            made = grown(made, bytes_of, shards - made.shards)
        edited = rebalanced(made, bytes_of, tolerance)
        lower = made.loads(bytes_of).max() - edited.loads(bytes_of).max()
        # Rows move only for a gain: what one slot's size leaves uneven makes no new versions.
        if lower > tolerance * bytes_of.sum() / shards:
            made = edited
    if made.version not in stored:
        made.save(spark, folder)
    return SlotMap.load(spark, folder, made.version)


def grown(old: SlotMap, bytes_of: np.ndarray, more: int = 1) -> SlotMap:
    """The next version with `more` shards: every old shard gives slots until the new ones have
    their share; rows move into new shards only."""
    shards = old.shards + more
    fair = bytes_of.sum() / shards
    loads = np.append(old.loads(bytes_of), np.zeros(more))
    shard = old.shard.copy()
    for s in np.argsort(-bytes_of, kind="stable"):
        i, j = shard[s], old.shards + int(np.argmin(loads[old.shards :]))
        if loads[i] - bytes_of[s] >= fair and loads[j] + bytes_of[s] <= fair:
            loads[i] -= bytes_of[s]
            loads[j] += bytes_of[s]
            shard[s] = j
    return SlotMap(old.version + 1, shards, shard)


def sharded(docs: DataFrame, slots: SlotMap, out: str = "shard") -> DataFrame:
    """docs with their shard (and `virtual_slot`); a map-side lookup of SLOTS rows, no shuffle.
    Columns of docs with these names are replaced."""
    kept = docs.drop(out, "virtual_slot")
    keyed = kept.withColumn("virtual_slot", virtual_slot(kept["doc_id"], kept["text"]))
    lookup = slots.frame(docs.sparkSession).toDF("virtual_slot", out)
    return keyed.join(F.broadcast(lookup), "virtual_slot").select(*kept.columns, out, "virtual_slot")


def placed(rows: DataFrame, slots: SlotMap, order: list[str]) -> DataFrame:
    """rows (with `slot`) with `shard` and `position`, gapless from 0 within each shard.

    Rows are numbered inside their virtual slot and moved up by the rows of the shard's earlier
    slots, so a window holds one slot, never a shard. Rows equal in `order` may swap places.
    """
    counts = {r.slot: r.n for r in rows.groupBy("slot").agg(F.count("*").alias("n")).collect()}
    n = np.array([counts.get(s, 0) for s in range(SLOTS)], np.int64)
    before = np.zeros(SLOTS, np.int64)
    for i in range(slots.shards):
        own = np.flatnonzero(slots.shard == i)
        before[own] = np.cumsum(n[own]) - n[own]
    lookup = rows.sparkSession.createDataFrame(
        [(s, int(slots.shard[s]), int(before[s])) for s in range(SLOTS)],
        "slot int, shard int, before long",
    )
    inside = F.row_number().over(Window.partitionBy("slot").orderBy(*order)) - 1
    return (
        rows.withColumn("position", inside)
        .join(F.broadcast(lookup), "slot")
        .withColumn("position", (F.col("position") + F.col("before")).cast("long"))
        .drop("before")
    )
