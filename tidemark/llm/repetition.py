"""Quality rules on repetition inside a text, from the suffix array of its words.

The suffix array is built by prefix doubling over word hashes, for many texts at a time; a
text's index is part of the first sort key, so no comparison crosses texts. The longest common
prefix of neighbouring suffixes comes from the ranks kept at each doubling. A word position p
then has `longest[p]`, the length of the longest substring starting there that occurs again in
the same text: the larger value of the two LCP intervals it borders. An occurrence of a maximal
repeat starts where `longest[p - 1] != longest[p] + 1` (else it lies inside the one before).
The union of the spans [p, p + longest[p]) of at least `least_words` words is the covered part.

Rule: a text is kept if at most `most_covered` of its words lie in repeats and no repeat is
longer than `most_repeat` words. Null and empty texts have no words, hence no repeats.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Tokens, chunks, tokenize, utf8

SYMBOLS = b"#*$%&|<>"
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, spans array<struct<start:int,end:int>>"
)


class Rules(NamedTuple):
    least_words: int = 8  # shorter repeats do not count as covered
    most_covered: float = 0.3  # share of words in repeats
    most_repeat: int = 60  # words of the longest repeat


def longest_repeats(tokens: Tokens) -> np.ndarray:
    """For each word position the length of the longest substring that starts there and occurs
    at least twice in its text; occurrences may overlap."""
    n = len(tokens.hash)
    if n == 0:
        return np.zeros(0, np.int64)
    last = np.flatnonzero(np.append(np.diff(tokens.text) != 0, True))
    stop = last[np.searchsorted(last, np.arange(n))] + 1  # end of the text of each position
    order = np.lexsort((tokens.hash, tokens.text))
    new = np.append(
        True,
        (tokens.hash[order[1:]] != tokens.hash[order[:-1]])
        | (tokens.text[order[1:]] != tokens.text[order[:-1]]),
    )
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, step = [rank], 1
    while True:
        # Suffixes that still share their rank with another are sorted on by what follows.
        shared = ~new | np.append(~new[1:], False)
        if not shared.any():
            break
        places = np.flatnonzero(shared)
        members = order[places]
        behind = members + step
        inside = behind < stop[members]
        second = np.where(inside, rank[np.minimum(behind, n - 1)] + 1, 0)
        first = rank[members]
        by = np.lexsort((second, first))
        members, first, second = members[by], first[by], second[by]
        order[places] = members
        fresh = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        new[places] = fresh
        rank = rank.copy()
        rank[members] = np.maximum.accumulate(np.where(fresh, places, 0))
        ranks.append(rank)
        step *= 2
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        held = ranks[level]
        pa, pb = a + lcp, b + lcp
        # Equal ranks mean 2**level equal words, or equal rests of one text, which differ in
        # length from each other and so never have equal ranks.
        ok = (pa < stop[a]) & (pb < stop[b])
        same = ok & (held[np.minimum(pa, n - 1)] == held[np.minimum(pb, n - 1)])
        lcp += np.where(same, 1 << level, 0)
    longest = np.zeros(n, np.int64)
    longest[a] = lcp
    longest[b] = np.maximum(longest[b], lcp)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """True for positions inside a repeat of at least `least` words."""
    start = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    edge[start] = 1
    np.add.at(edge, start + longest[start], -1)
    return np.cumsum(edge)[:-1] > 0


def maximal(longest: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Positions where an occurrence of a maximal repeat of at least `least` words starts."""
    if not len(longest):
        return np.zeros(0, np.int64)
    before = np.append(0, np.where(text[1:] == text[:-1], longest[:-1], 0))
    return np.flatnonzero((longest >= least) & (before != longest + 1))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measured(texts: list[bytes], rules: Rules) -> pd.DataFrame:
    tokens = tokenize(texts)
    longest = longest_repeats(tokens)
    count = lambda flags: np.bincount(tokens.text[flags], minlength=len(texts))
    inside = covered(longest, rules.least_words)
    cuts = np.searchsorted(tokens.text, np.arange(len(texts) + 1))
    n = np.diff(cuts)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, tokens.text, longest)
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    follows = np.append(0, np.cumsum((buffer & 0xC0) == 0x80))
    size = tokens.end - tokens.start - (follows[tokens.end] - follows[tokens.start])
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    parted = np.append(np.flatnonzero(np.diff(tokens.text)) + 1, len(inside))
    breaks = parted[inside[np.minimum(parted, len(inside) - 1)] & inside[parted - 1]] if len(inside) else []
    starts = np.union1d(np.flatnonzero(edge == 1), [x for x in breaks if x < len(inside)])
    ends = np.union1d(np.flatnonzero(edge == -1), [x for x in breaks if x < len(inside)])
    starts, ends = starts.astype(np.int64), ends.astype(np.int64)
    owner = tokens.text[starts] if len(starts) else starts
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    spans = [
        [
            {"start": int(s - cuts[i]), "end": int(e - cuts[i])}
            for s, e in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])
        ]
        for i in range(len(texts))
    ]
    return pd.DataFrame(
        {
            "n_words": n,
            "word_chars": np.bincount(tokens.text, size, len(texts)).astype(np.int64),
            "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
            "n_dup_lines": [repeated_lines(t) for t in texts],
            "n_repeat_words": count(covered(longest, 3)),
            "covered_words": count(inside),
            "longest_repeat": most,
            "spans": spans,
        }
    )


def repetition(text: Column, rules: Rules = Rules()) -> Column:
    """The measures of a whole text as a struct, spans in word positions. Null counts as empty."""

    @F.pandas_udf(FIELDS)
    def measures(texts: pd.Series) -> pd.DataFrame:
        parts = [measured(part, rules) for part in chunks(utf8(texts))]
        return pd.concat(parts, ignore_index=True) if parts else measured([], rules)

    return measures(text)


def verdict(measures: Column, rules: Rules = Rules()) -> Column:
    """True where the method keeps a text."""
    return (measures["covered_words"] <= rules.most_covered * measures["n_words"]) & (
        measures["longest_repeat"] <= rules.most_repeat
    )


def judged(docs: DataFrame, rules: Rules = Rules(), out: str = "repetition") -> DataFrame:
    """docs with the measures and `<out>_kept`; all other columns pass through."""
    measures = docs.withColumn(out, repetition(docs["text"], rules))
    return measures.withColumn(f"{out}_kept", verdict(measures[out], rules))
