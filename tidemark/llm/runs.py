"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q, of at least max(least, 2 q)
words, that no neighbouring word extends keeping period q.

Suffixes of a text are sorted by prefix doubling over word hashes (many texts at a time; the
text is part of the first key), and neighbours in that order are the edges of a graph, weighed by
their longest common prefix (LCP). Edges are taken by decreasing LCP, and the two classes of
suffixes that an edge joins are united: a class is the sorted set of its positions, the smaller
one is inserted into the larger one. Two positions i < j that become neighbours in the united set
have exactly this LCP, as no earlier edge joined them. If their distance d is at most the LCP, the
words from i on repeat with period d for LCP + d words, and d is the smallest such period: a
smaller one would have put a position between them at a higher LCP. The pair seeds a run where
the words before i and j differ (or i is the first word); other pairs lie inside the same run.

A run of length L and period q is seeded by an LCP of L - q >= L / 2, so edges below least / 2 are
left out: ordinary text has hardly any left, and the loop below runs over repeated stretches
only. Words are compared by 64-bit hashes (chance of a collision about 2**-60 a pair).

Null and empty texts have no words and no runs. Rows may repeat and need no id.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Tokens, chunks, tokenize, utf8

LEAST = 12
FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def edges(tokens: Tokens, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, lcp), lcp falling: neighbours in suffix order that share `least` words or more."""
    word, text, n = tokens.hash, tokens.text, len(tokens.hash)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    stop = np.searchsorted(text, text, "right")  # end of the text of each position
    order = np.lexsort((word, text))
    leads = np.append(True, (np.diff(text[order]) != 0) | (word[order][1:] != word[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(leads, np.arange(n), 0))
    ranks = [rank]
    while not leads.all():
        # Places whose suffix still ties with a neighbour are sorted by the words behind.
        tied = np.flatnonzero(~leads | np.append(~leads[1:], False))
        own = order[tied]
        behind = own + (1 << (len(ranks) - 1))
        follow = np.where(behind < stop[own], rank[np.minimum(behind, n - 1)], -1)
        group = rank[own]
        by = np.lexsort((follow, group))
        own, follow, group = own[by], follow[by], group[by]
        order[tied] = own
        leads[tied] = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(leads[tied], tied, 0))
        ranks.append(rank)
    # Equal ranks at a level are equal words; suffixes that end are never equal to others.
    level = min(len(ranks) - 1, least.bit_length() - 1)
    a, b = order[:-1], order[1:]
    near = (ranks[level][a] == ranks[level][b]) if least > 1 else text[a] == text[b]
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        pa, pb = a + lcp, b + lcp
        inside = (pa < stop[a]) & (pb < stop[b])
        same = ranks[level][np.minimum(pa, n - 1)] == ranks[level][np.minimum(pb, n - 1)]
        lcp += (inside & same) * (1 << level)
    kept = np.flatnonzero(lcp >= least)
    kept = kept[np.argsort(-lcp[kept], kind="stable")]
    return a[kept], b[kept], lcp[kept]


def found_runs(tokens: Tokens, least: int = LEAST) -> np.ndarray:
    """Rows (position of the first word, length, period) of all runs, sorted."""
    a, b, lcp = edges(tokens, max(1, -(-least // 2)))
    word, text = tokens.hash, tokens.text
    home: dict[int, list[int]] = {}
    seeds = []
    for i, j, common in zip(a.tolist(), b.tolist(), lcp.tolist()):
        large, small = home.setdefault(i, [i]), home.setdefault(j, [j])
        if len(large) < len(small):
            large, small = small, large
        for x in small:
            insort(large, x)
        for x in small:
            at = bisect_left(large, x)
            if at and home[large[at - 1]] is not small and x - large[at - 1] <= common:
                seeds.append((large[at - 1], x, common))
            if at + 1 < len(large) and home[large[at + 1]] is not small and large[at + 1] - x <= common:
                seeds.append((x, large[at + 1], common))
        for x in small:
            home[x] = large
    if not seeds:
        return np.zeros((0, 3), np.int64)
    i, j, common = np.array(seeds, np.int64).T
    opens = (i == 0) | (text[i - 1] != text[i]) | (word[i - 1] != word[j - 1])
    held = opens & (common + j - i >= least)
    out = np.stack([i, common + j - i, j - i], 1)[held]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def measured(texts: list[bytes], least: int) -> pd.DataFrame:
    """One row of FIELDS per text."""
    tokens = tokenize(texts)
    out = found_runs(tokens, least)
    cuts = np.searchsorted(tokens.text, np.arange(len(texts) + 1))
    edge = np.zeros(len(tokens.hash) + 1, np.int64)
    np.add.at(edge, out[:, 0] + out[:, 2], 1)
    np.add.at(edge, out[:, 0] + out[:, 1], -1)
    stays = np.cumsum(edge)[:-1] == 0
    owner = tokens.text[out[:, 0]] if len(out) else np.zeros(0, np.int64)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    runs, collapsed = [], []
    for k, text in enumerate(texts):
        own, words = out[at[k] : at[k + 1]], text.split()
        if len(own):
            words = [words[w] for w in np.flatnonzero(stays[cuts[k] : cuts[k + 1]]).tolist()]
        first = int(cuts[k])
        runs.append([{"start": s - first, "length": n, "period": q} for s, n, q in own.tolist()])
        collapsed.append(b" ".join(words).decode())
    return pd.DataFrame({"n_words": np.diff(cuts), "runs": runs, "collapsed": collapsed})


def periodic(text: Column, least: int = LEAST) -> Column:
    """A struct of FIELDS: the number of words, the runs by start and period, and the words left
    without what a run repeats (all of it behind the run's first period), joined by one space."""

    @F.pandas_udf(FIELDS)
    def runs(texts: pd.Series) -> pd.DataFrame:
        parts = [measured(part, least) for part in chunks(utf8(texts))]
        return pd.concat(parts, ignore_index=True) if parts else measured([], least)

    return runs(text)


def detected(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """`docs` with a struct column `periodic`, which replaces one of that name."""
    return docs.withColumn("periodic", periodic(F.col(text), least))
