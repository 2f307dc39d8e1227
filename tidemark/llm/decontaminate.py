"""Benchmark decontamination with spaced seeds.

Texts become tokens: runs of letters and digits, A-Z lower-cased. A mask keeps some positions of
a window and ignores the others, so a replaced token spoils only the windows that keep it. The
masked windows of the benchmark are hashed; each document's masked windows are looked up among
them, and every hit names a diagonal (document position minus item position). Along the diagonal
the best segment is scored (match 1, mismatch -2); an overlap counts if its matches reach
`least_matched`, or `short_share` of the item if that is less. The masks are chosen so that with the
default rules every overlap that counts is hit by one of them, wherever tokens are replaced
(tests/llm enumerates that); shorter items have lighter and shorter masks. Precision is left to the
score. Items under SHORTEST tokens are not looked for.

The benchmark is the stated query set. It goes to the executors in blocks of at most
BLOCK_TOKENS tokens (a longer item is a block of its own), whatever its size; documents are
never shuffled. Null or empty texts overlap with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import BLANK, WORDS, chunks, mixed, tokenize, utf8

#: Masks by the length of the items that they are for; the last ones are for all longer items.
#: Any 13 matches of a segment whose score never falls below 0 hold one of these.
_LONG = ("1110101001", "110100110001", "110110000101", "11010001011", "1111011", "11110011")
_BRIEF = ("111111", "1110111", "1101111")
MASKS = {
    5: ("1111",),
    6: ("11111", "110111"),
    7: _BRIEF,
    8: _BRIEF,
    9: _BRIEF,
    10: ("11010111", "110110011"),
    11: ("110100111", "1110111"),
    12: _LONG,
}
SHORTEST, LONGEST = min(MASKS), max(MASKS)
BLOCK_TOKENS = 4_000_000
_ALNUM = WORDS.copy()
_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = BLANK
_FACTOR = np.random.default_rng(7).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_FILTER_BITS = 22
OVERLAPS = "array<struct<item_id:long,at:int,item_at:int,length:int,matched:int>>"


class Rules(NamedTuple):
    least_matched: int = 13
    short_share: float = 0.8


class Block(NamedTuple):
    """Some items: their tokens one after the other, and for every mask the hashes of its
    windows, sorted, with the position of the window."""

    ids: list
    token: np.ndarray
    item: np.ndarray  # of each token
    start: np.ndarray  # first token of each item, and the end
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # kept offsets, hashes, positions


def windows(token: np.ndarray, owner: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the masked windows that lie in one text; kept ends with the last
    offset of the mask."""
    n = len(token) - kept[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[kept[-1] :])
    value = np.zeros(len(at), np.uint64)
    for offset in kept:
        value += token[at + offset] * _FACTOR[offset]
    return at, mixed(value)


def block_of(ids: list, texts: list[bytes]) -> Block:
    found = tokenize([t.lower() for t in texts], _ALNUM)
    start = np.searchsorted(found.text, np.arange(len(texts) + 1))
    size = np.diff(start)
    length = np.minimum(size, LONGEST)
    lengths: dict[str, list[int]] = {}
    for n in np.unique(length[size >= SHORTEST]).tolist():
        for mask in MASKS[n]:
            lengths.setdefault(mask, []).append(n)
    seeds = []
    for mask, own in lengths.items():
        kept = np.flatnonzero([c == "1" for c in mask])
        at, value = windows(found.hash, found.text, kept)
        fit = np.isin(length[found.text[at]], own)
        at, value = at[fit], value[fit]
        order = np.argsort(value, kind="stable")
        seeds.append((kept, value[order], at[order]))
    return Block(ids, found.hash, found.text, start, seeds)


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items in the order of their ids, block by block; null ids come first."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = (row.text or "").encode()
        n = len(text.split())
        if texts and held + n > BLOCK_TOKENS:
            yield block_of(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(text)
        held += n
    if texts:
        yield block_of(ids, texts)


def filters(block: Block) -> list[np.ndarray]:
    """For every mask a bit table of fixed size that rules out most windows at once."""
    out = []
    for _, value, _ in block.seeds:
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[value >> np.uint64(64 - _FILTER_BITS)] = True
        out.append(table)
    return out


def diagonals(block: Block, seen: list[np.ndarray], token: np.ndarray, owner: np.ndarray):
    """Distinct (document token position, item token position) of the hits, one a diagonal."""
    pairs = []
    for (kept, value, position), table in zip(block.seeds, seen):
        if not len(value):
            continue
        at, found = windows(token, owner, kept)
        likely = table[found >> np.uint64(64 - _FILTER_BITS)]
        at, found = at[likely], found[likely]
        low, high = np.searchsorted(value, found, "left"), np.searchsorted(value, found, "right")
        many = high - low
        first = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs.append(np.stack([np.repeat(at, many), position[first]], 1))
    if not pairs:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate(pairs)
    key = np.stack([pairs[:, 0] - pairs[:, 1], owner[pairs[:, 0]], block.item[pairs[:, 1]]], 1)
    _, one = np.unique(key, axis=0, return_index=True)
    return pairs[one]


def best_segment(same: np.ndarray) -> tuple[int, int]:
    """[start, end) of the best scored segment of a diagonal."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.argmin(score[: end + 1]))
    return start, end


def overlaps_of(block: Block, seen: list[np.ndarray], texts: list[bytes], rules: Rules) -> list[list]:
    """Per text its overlaps with the items of a block, the best diagonal for each item."""
    found = tokenize([t.lower() for t in texts], _ALNUM)
    start = np.searchsorted(found.text, np.arange(len(texts) + 1))
    best: list[dict] = [{} for _ in texts]
    for p, q in diagonals(block, seen, found.hash, found.text):
        text, item = found.text[p], block.item[q]
        back = min(p - start[text], q - block.start[item])
        ahead = min(start[text + 1] - p, block.start[item + 1] - q)
        same = found.hash[p - back : p + ahead] == block.token[q - back : q + ahead]
        a, b = best_segment(same)
        matched = int(same[a:b].sum())
        whole = int(block.start[item + 1] - block.start[item])
        if matched < min(rules.least_matched, rules.short_share * whole):
            continue
        at = int(p - back + a - start[text])
        entry = (matched, -at, int(q - back + a - block.start[item]), b - a)
        if best[text].get(item, (0,)) < entry:
            best[text][item] = entry
    return [
        [
            {"item_id": block.ids[item], "at": -e[1], "item_at": e[2], "length": e[3], "matched": e[0]}
            for item, e in sorted(own.items())
        ]
        for own in best
    ]


def overlaps(benchmark: DataFrame, text: Column, rules: Rules = Rules()) -> Column:
    """The overlaps of a text with the benchmark: an array of (item_id, at, item_at, length,
    matched), positions in tokens. Two items that share an id are reported one by one."""
    parts = [_searched(block, rules)(text) for block in blocks(benchmark)]
    return F.concat(*parts) if parts else F.array().cast(OVERLAPS)


def _searched(block: Block, rules: Rules):
    @F.pandas_udf(OVERLAPS)
    def search(texts: pd.Series) -> pd.Series:
        seen, out = filters(block), []
        for part in chunks(utf8(texts)):
            out += overlaps_of(block, seen, part, rules)
        return pd.Series(out, dtype=object)

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document row and item that overlap."""
    rows = docs.select("doc_id", F.explode(overlaps(benchmark, docs["text"], rules)).alias("o"))
    return rows.select("doc_id", "o.*")


def clean(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents without any overlap, where they are."""
    return docs.filter(F.size(overlaps(benchmark, docs["text"], rules)) == 0)
