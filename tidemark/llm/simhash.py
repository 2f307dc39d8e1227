"""Near copies by SimHash fingerprints and vantage-point trees.

Fingerprint: A-Z lower-cased, shingles of `words` words joined by one space (repeats count; a
shorter text is one shingle; no words: fingerprint 0), XXH64 with seed 42 of each; a bit is set
if it is set in over half of the hashes.

Search: equal fingerprints are one. A routing tree of vantage points, built from a bounded
sample (`SAMPLE`), parts the fingerprints into shards by their Hamming distance: beyond a
vantage point's radius or within. Every fingerprint has a home shard and is sent as a query to
all shards that the triangle inequality does not rule out, so no pair within the bound is lost.
Each shard builds its own tree, finds the pairs, and returns a spanning forest of them, never
the pairs: at most one edge a fingerprint. Edges of all shards are joined to components by
alternating star contractions, one small job after the other, checkpointed.

Null text counts as empty. Null ids take no part in the minimum; a component of null ids only
has a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import chunks, fixed, utf8
from tidemark.session import broadcast_if_small

#: Fingerprints of the routing tree's sample, and those wanted in a shard. The tree has at most
#: SAMPLE / 16 shards; beyond SHARD * SAMPLE / 16 fingerprints the shards grow instead.
SAMPLE = 1 << 18
SHARD = 1 << 15
#: Pairs compared at once inside a shard, and fingerprints below which a tree is not split.
BLOCK = 1 << 20
LEAF = 64
#: Ids of copies that are broadcast after counting them; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def fingerprint_of(text: bytes, words: int) -> int:
    """The unsigned fingerprint of one text."""
    hashes = shingle_hashes(text, words)
    return int(majority(hashes)) if len(hashes) else 0


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 16):
        part = hashes[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 with seed 42 of every shingle, repeats included; none without words."""
    parts = text.lower().split()
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)] if parts else [], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(parts) - words + 1].tolist()
    end = end[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(start, end)), np.uint64, len(start))


def fingerprint(text: Column, words: int = 3) -> Column:
    """Fingerprint of a whole text as a long (the 64 bits, signed)."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        found = [fingerprint_of(t, words) for part in chunks(utf8(texts)) for t in part]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    return prints(text)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def link(prints: np.ndarray, home: np.ndarray, bound: int) -> np.ndarray:
    """Roots of the sets that pairs within `bound` form in one shard; of each pair at least one
    fingerprint is at home."""
    forest = Forest(len(prints))
    near = lambda q, p: distance(prints[q][:, None], prints[p][None, :]) <= bound
    spread = lambda q, point: distance(prints[q], prints[point]).astype(np.int64)
    search(forest, near, spread, np.arange(len(prints)), np.flatnonzero(home), bound)
    return forest.roots(np.arange(len(prints)))


class Node:
    """Inner node: a vantage point and its radius; points within it go left. Leaf: a number."""

    __slots__ = ("leaf", "left", "point", "radius", "right")

    def __init__(self, point=None, radius=0, left=None, right=None, leaf=-1):
        self.point, self.radius, self.left, self.right, self.leaf = point, radius, left, right, leaf


def halving(found: np.ndarray) -> int:
    """The radius that halves these distances best."""
    counts = np.cumsum(np.bincount(found))
    return int(np.argmin(np.abs(counts - len(found) / 2)))


def split(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point (the first one), its radius, and who is within; None if all are."""
    found = distance(points, points[0])
    radius = halving(found)
    within = found <= radius
    return None if within.all() else (points[0], radius, within)


def routing_tree(points: np.ndarray, leaves: int) -> tuple[Node, int]:
    """A tree of about `leaves` leaves over a sample, halved where the sample is halved."""
    numbered = 0

    def build(part: np.ndarray, depth: int) -> Node:
        nonlocal numbered
        parted = split(part) if depth and len(part) > 1 else None
        if parted is None:
            numbered += 1
            return Node(leaf=numbered - 1)
        point, radius, within = parted
        return Node(point, radius, build(part[within], depth - 1), build(part[~within], depth - 1))

    return build(points, math.ceil(math.log2(max(1, leaves)))), numbered


def route(root: Node, points: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, is it the home leaf) for each leaf a ball of radius `bound`
    around a point can reach."""
    out = []

    def walk(node: Node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node.point is None:
            out.append((at, np.full(len(at), node.leaf), home))
            return
        found = distance(points[at], node.point).astype(np.int64)
        within = found <= node.radius
        to = found <= node.radius + bound
        walk(node.left, at[to], (home & within)[to])
        to = found > node.radius - bound
        walk(node.right, at[to], (home & ~within)[to])

    walk(root, np.arange(len(points)), np.ones(len(points), bool))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


class Forest:
    """Disjoint sets over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        found = self.parent[of]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                self.parent[of] = found
                return found
            found = above

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, pairs: Iterator[tuple[int, int]]) -> None:
        for i, j in pairs:
            i, j = self.find(i), self.find(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def absorb(self, near: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Join left[i] and right[j] wherever near[i, j]. Each round joins one partner a row and
        a column and forgets what is joined, so dense blocks never become lists of pairs."""
        while near.any():
            apart = near & (self.roots(left)[:, None] != self.roots(right)[None, :])
            rows, columns = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
            self.join(zip(left[rows], right[apart[rows].argmax(1)]))
            self.join(zip(left[apart[:, columns].argmax(0)], right[columns]))
            near = apart


def search(
    forest: Forest, near, spread, queries: np.ndarray, points: np.ndarray, bound: int, block: int = BLOCK
) -> None:
    """Join all pairs of a query and a point that `near` finds, by a vantage-point tree over the
    points: a branch is left out where no ball of radius `bound` around a query reaches it."""
    if not len(queries) or not len(points):
        return
    if len(points) > LEAF:
        found = spread(points, points[0])
        radius = halving(found)
        within = found <= radius
        if not within.all():
            away = spread(queries, points[0])
            search(forest, near, spread, queries[away <= radius + bound], points[within], bound, block)
            search(forest, near, spread, queries[away > radius - bound], points[~within], bound, block)
            return
    step = max(1, block // len(points))
    for s in range(0, len(queries), step):
        part = queries[s : s + step]
        found = near(part, points)
        some = found.any(1)
        if some.any():
            forest.absorb(found[some], part[some], points)


def edges(prints: DataFrame, bound: int) -> DataFrame:
    """(u, v), u > v: a spanning forest of the pairs of distinct fingerprints (column fp) that
    differ in at most `bound` bits."""
    n = prints.count()
    leaves = min(max(1, n // SHARD), SAMPLE // 16)
    drawn = prints.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, 64 * leaves))
    sample = np.array([r.fp for r in drawn.collect()], np.int64).view(np.uint64)
    root, leaves = routing_tree(sample, leaves) if len(sample) else (Node(leaf=0), 1)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["fp"].to_numpy()
            at, leaf, home = route(root, own.view(np.uint64), bound)
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "fp": own[at], "home": home.astype(bool)})

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fp", ignore_index=True)
        own = frame["fp"].to_numpy()
        top = own[link(own.view(np.uint64), frame["home"].to_numpy(), bound)]
        far = own != top
        return pd.DataFrame({"u": own[far], "v": top[far]})

    sent = prints.select("fp").mapInPandas(send, "leaf int, fp long, home boolean")
    return sent.groupBy("leaf").applyInPandas(find, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has a link.

    Large-star and small-star rounds in turn until nothing changes. A hub is only ever the
    left, splittable side of a join; minima combine before the shuffle.
    """
    current, before = fixed(links.select("u", "v").filter("u > v").distinct()), None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        current = fixed(small.select("e.*").filter("u > v").distinct())
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            break
        before = state
    return current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def named(rows: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of rows (doc_id, fp), given prints (fp, least doc_id)."""
    roots = components(links)
    joined = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(fixed(joined.join(ids, "root").select("fp", "component_id")), "fp")


def clustered(docs: DataFrame, words: int = 3, bound: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links, for every row."""
    rows = fixed(docs.select("doc_id", fingerprint(docs["text"], words).alias("fp")))
    prints = fixed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return named(rows, prints, edges(prints, bound))
