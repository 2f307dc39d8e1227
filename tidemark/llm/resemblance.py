"""Near copies at a Jaccard similarity of 0.8 or more over the sets of word shingles.

Candidates come from wide SimHashes, the decision from the whole shingle sets. At this similarity
about 15 % of the bits of two SimHashes differ. That is far beyond what triangle bounds can prune
over a whole corpus (any two fingerprints lie within 50 % +- a little), so vantage-point shards
alone would compare everything with everything. Here the shards are made by anchors first: of the
ANCHORS_DRAWN smallest shingle hashes of a text (its bottom sketch) the ANCHORS rarest in the
corpus name its shards. Inside a shard vantage-point trees over fingerprints of 256 bits find the
candidates: pairs whose similarity, estimated from their differing bits and the two numbers of
shingles, reaches ROUGH. That lies so far below 0.8 that in a simulation at 0.8 fewer than one pair
in 1,000 is lost, also where few shingles make a poor fingerprint.

The components of the candidates then get their texts, each once, and every pair of a component
that is not yet joined is compared by its whole shingle sets, whatever their length. Only pairs of
`least` or more are joined. Shingles are compared by 64-bit hashes.

A shard of more than SHARD texts, or a component of more than SETS, is dealt in blocks, and every
pair of blocks is a task of its own: bounded memory and no lost pair, at a cost that grows with
the square of the distinct near copies of one text. Texts of equal words are one text throughout. As
everywhere, a shard returns a spanning forest, never its pairs.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.simhash import MOST_BROADCAST, Forest, components, majority, named, search, shingle_hashes
from tidemark.llm.text import fixed, mixed, utf8
from tidemark.session import broadcast_if_small

WORDS, LEAST = 5, 0.8
# Pairs of this estimate or more are compared by their sets.
ROUGH = 0.5
BITS, PARTS = 256, 4
ANCHORS_DRAWN, ANCHORS = 16, 8
# Texts of a block: with sketches, and with whole texts.
SHARD, SETS = 1 << 13, 1 << 11
TASKS = 1 << 12
# Pairs of fingerprints compared at once: some 100 bytes each.
PAIRS = 1 << 17
_SALT = np.uint64(0x632BE59BD9B4E019)
_SALTS = np.arange(PARTS, dtype=np.uint64) * _SALT
FIELDS = "node long, f0 long, f1 long, f2 long, f3 long, n int, low array<long>"


def give_back() -> None:
    """Return freed memory to the system. Workers live on from stage to stage, and arrays of many
    sizes leave an allocator with far more than it uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def words_hash(text: bytes) -> int:
    """Signed hash of the words of a text, A-Z lower-cased; 0 without words."""
    parts = text.lower().split()
    value = xxhash.xxh64_intdigest(b" ".join(parts), 42) if parts else 0
    return value - (1 << 64) if value >> 63 else value


def node_of(text: Column) -> Column:
    @F.pandas_udf("long")
    def nodes(texts: pd.Series) -> pd.Series:
        made = pd.Series([words_hash(t) for t in utf8(texts)], dtype=np.int64)
        give_back()
        return made

    return nodes(text)


def sketch_of(text: bytes, words: int) -> tuple:
    """The hash of its words, 256 bits over the distinct shingles, their number, and the smallest
    salted hashes."""
    hashes = np.unique(shingle_hashes(text, words))
    if not len(hashes):
        return (0, 0, 0, 0, 0, 0, [])
    wide = [majority(mixed(hashes + salt)) for salt in _SALTS]
    low = np.sort(mixed(hashes ^ _SALT))[:ANCHORS_DRAWN].view(np.int64)
    return (words_hash(text), *np.array(wide, np.uint64).view(np.int64).tolist(), len(hashes), low.tolist())


def sketch(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf(FIELDS)
    def sketches(texts: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        made = pd.DataFrame([sketch_of(t, words) for t in utf8(texts)], columns=names)
        give_back()
        return made

    return sketches(text)


def similarity(differing: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of two sets of a and b shingles, estimated from differing bits."""
    common = np.cos(np.pi * differing / BITS) * np.sqrt(a * b)
    return common / np.maximum(a + b - common, 1e-9)


def widest(least: float) -> int:
    """The largest number of differing bits at which equal sizes still reach `least`."""
    return int(np.floor(np.arccos(2 * least / (1 + least)) / np.pi * BITS))


def linked(wide: np.ndarray, n: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Roots of the sets that candidates form in one shard. side: 0 meets all, 1 meets 2 only."""
    forest = Forest(len(n))
    bits = lambda q, p: np.bitwise_count(wide[q] ^ wide[p]).sum(-1, dtype=np.int64)

    def near(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        return similarity(bits(q[:, None], p[None, :]), n[q][:, None], n[p][None, :]) >= ROUGH

    spread = lambda q, point: bits(q, np.array([point]))
    queries, points = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    search(forest, near, spread, queries, points, widest(ROUGH), PAIRS)
    return forest.roots(np.arange(len(n)))


def alike(sets: list[np.ndarray], side: np.ndarray, least: float) -> np.ndarray:
    """Roots of the sets that pairs of a Jaccard similarity of `least` or more form; side as in
    `linked`. A pair is compared unless it is joined already or its sizes rule it out."""
    forest, n = Forest(len(sets)), np.array([len(x) for x in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(code, np.cumsum(n)[:-1])
    mark, everyone = np.zeros(len(values), bool), np.arange(len(sets))
    for p in range(len(sets)):
        if side[p] == 2:
            continue
        root = forest.roots(everyone)
        apart = (root != root[p]) & (np.minimum(n, n[p]) >= least * np.maximum(n, n[p]) - 1e-9)
        apart &= (side == 2) if side[p] == 1 else (everyone > p)
        if not apart.any():
            continue
        mark[codes[p]] = True
        for q in np.flatnonzero(apart).tolist():
            common = int(np.count_nonzero(mark[codes[q]]))
            if common >= least * (n[p] + n[q] - common) - 1e-9:
                forest.join([(p, q)])
        mark[codes[p]] = False
    return forest.roots(everyone)


def dealt(keyed: DataFrame, group: str, most: int) -> DataFrame:
    """Rows (node, texts: the number of its group, ...) with task and side; a group of more than
    `most` texts is dealt in blocks, one task for every pair of them."""
    blocks = F.ceil(F.col("texts") / most).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    keyed = keyed.withColumn("blocks", blocks).withColumn("block", block)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return (
        keyed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("side", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") == low, 1).otherwise(2))
        .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(TASKS))).otherwise(
            F.xxhash64(group, low, high)
        ))
        .drop("texts", "blocks", "block", "other")
    )


def shards(texts: DataFrame) -> DataFrame:
    """texts (node, f0..f3, n, low) by task and anchor, with the side of a block."""
    drawn = texts.select("node", F.explode("low").alias("anchor"))
    counted = drawn.groupBy("anchor").agg(F.count("*").alias("texts")).filter("texts > 1")
    chosen = (
        drawn.join(fixed(counted), "anchor")
        .groupBy("node")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("texts", "anchor"))), 1, ANCHORS).alias("a"))
        .select("node", F.explode("a").alias("a"))
        .select("node", "a.texts", "a.anchor")
    )
    return dealt(texts.drop("low").join(chosen, "node"), "anchor", SHARD)


def forests(frame: pd.DataFrame, group: str, roots) -> pd.DataFrame:
    """(u, v) for every row that is not the root of its set; roots(a, b) are those of the rows
    [a, b), one group."""
    node, key = frame["node"].to_numpy(), frame[group].to_numpy()
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    u, v = [], []
    for a, b in zip(cuts, np.append(cuts[1:], len(key))):
        if b - a < 2:
            continue
        top = roots(a, b)
        far = np.flatnonzero(top != np.arange(b - a))
        u.append(node[a + far])
        v.append(node[a + top[far]])
    none = np.zeros(0, np.int64)
    if len(frame) > 1000:
        give_back()
    return pd.DataFrame({"u": np.concatenate([*u, none]), "v": np.concatenate([*v, none])})


def candidates(texts: DataFrame) -> DataFrame:
    """(u, v), u > v: a spanning forest of the candidates of every shard."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["anchor", "node"], ignore_index=True)
        wide = frame[["f0", "f1", "f2", "f3"]].to_numpy().view(np.uint64)
        n, side = frame["n"].to_numpy().astype(float), frame["side"].to_numpy()
        return forests(frame, "anchor", lambda a, b: linked(wide[a:b], n[a:b], side[a:b]))

    found = shards(texts).groupBy("task").applyInPandas(find, "u long, v long")
    return found.distinct()


def edges(docs: DataFrame, found: DataFrame, words: int, least: float) -> DataFrame:
    """(u, v), u > v: a spanning forest of the near pairs, by whole sets, in every component of
    the candidates found."""
    linked_to = fixed(components(found))
    members = linked_to.union(linked_to.select(F.col("root").alias("node"), "root").distinct())
    sizes = members.groupBy("root").agg(F.count("*").alias("texts"))
    members = broadcast_if_small(fixed(members.join(sizes, "root")), MOST_BROADCAST)
    texts = docs.select(node_of(docs["text"]).alias("node"), "text").join(members, "node")
    texts = texts.groupBy("node", "root", "texts").agg(F.first("text").alias("text"))

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["root", "node"], ignore_index=True)
        side, text = frame["side"].to_numpy(), frame["text"]

        def roots(a: int, b: int) -> np.ndarray:
            sets = [np.unique(shingle_hashes(t, words)) for t in utf8(text[a:b])]
            return alike(sets, side[a:b], least)

        return forests(frame, "root", roots)

    return dealt(texts, "root", min(SETS, SHARD)).groupBy("task").applyInPandas(find, "u long, v long")


def clustered(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, fp and component_id for every row, as simhash.clustered; fp is the hash of the
    words."""
    made = docs.select("doc_id", sketch(docs["text"], words).alias("s"))
    rows = fixed(made.select("doc_id", "s.*").withColumnRenamed("node", "fp"))
    columns = [F.first(c).alias(c) for c in ("f0", "f1", "f2", "f3", "n", "low")]
    texts = fixed(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"), *columns))
    prints = texts.select(F.col("node").alias("fp"), "least")
    found = edges(docs, candidates(texts.drop("least")), words, least)
    return named(rows.select("doc_id", "fp"), prints, found)


def without_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, then the smallest hash of
    its text; a row without an id only where its group has none with one.

    Rows are told apart by id and text, so a row stays or goes by its own text, whatever other
    rows share its id. Of rows equal in both, one stays.
    """
    text_key = F.xxhash64(docs["text"])
    made = docs.select("doc_id", text_key.alias("text_key"), sketch(docs["text"], words).alias("s"))
    rows = fixed(made.select("doc_id", "text_key", "s.*").withColumnRenamed("node", "fp"))
    columns = [F.first(c).alias(c) for c in ("f0", "f1", "f2", "f3", "n", "low")]
    texts = fixed(rows.groupBy(F.col("fp").alias("node")).agg(*columns))
    roots = components(edges(docs, candidates(texts), words, least))
    members = rows.select("doc_id", "text_key", "fp").join(roots, F.col("fp") == F.col("node"), "left")
    counted = fixed(
        members.groupBy(F.coalesce("root", "fp").alias("root"), "doc_id", "text_key").agg(F.count("*").alias("n"))
    )
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    heads = counted.groupBy("root").agg(F.min(place).alias("head"))
    decided = fixed(
        counted.join(heads, "root").select(
            F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n", (place == F.col("head")).alias("first")
        )
    )
    gone = broadcast_if_small(decided.filter("not first").select("_id", "_key"), MOST_BROADCAST)
    own = docs["doc_id"].eqNullSafe(F.col("_id")) & (text_key == F.col("_key"))
    kept = docs.join(gone, own, "left_anti")
    again = decided.filter("first and n > 1").select("_id", "_key")
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again, MOST_BROADCAST)
    keyed = kept.join(again, own, "left_semi").withColumn("_text_key", text_key)
    one = keyed.dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
    return kept.join(again, own, "left_anti").union(one)
