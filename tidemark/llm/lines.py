"""Near-duplicate lines by deletion neighbourhoods, over words.

Two lines are near if one word is replaced, added or removed between them (edit bound 1), and
both have at least `least_words` words; shorter lines must be equal. Lines without a word stay.
A line goes if an earlier one, by (doc_id, line number), equals it or is near it; the earliest
stays. The relation is not carried on: a line near a removed line goes as well.

Method: a line's variants are itself and all its sequences with one word left out, each as a
hash. Two lines are at distance 1 exactly if they share a variant and either both left out the
same place (replacement) or one of the two is whole (addition, removal). So the equality of
variants with their places verifies the distance, and the earliest line of a group of variants
is a minimum: no pairs are formed, whatever the size of a group.

Most lines have no near line. If two lines are near, they share the first or the last half of
the shorter one, so only lines that share such a half with another line make variants. This is
a filter, not a cap: no pair is lost. Hashes have 64 bits; different sequences share one with a
chance of about 2**-60.

Null ids sort last. In decisions rows that share an id are one document, and equal places are one
line; `cleaned` tells rows apart by id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import chunks, fixed, mixed, tokenize, utf8
from tidemark.operators.ordering import with_position
from tidemark.session import broadcast_if_small

LEAST_WORDS = 8
MOST_BROADCAST = 1_000_000
_B = 0xD1342543DE82EF95
_INVERSE = pow(_B, -1, 1 << 64)
_LENGTH, _SIDE = np.uint64(0x9FB21C651E98DF25), np.uint64(0xDA942042E4DD58B5)
NULL_ID = (1 << 63) - 1


class Sequences:
    """Hashes of word sequences [a, b) of a token array, from one prefix sum."""

    def __init__(self, token: np.ndarray):
        n = len(token)
        self.power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _B, np.uint64)))
        self.back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _INVERSE, np.uint64)))
        self.prefix = np.append(np.uint64(0), np.cumsum(token * self.power[:n], dtype=np.uint64))

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.prefix[b] - self.prefix[a]) * self.back[a]

    def whole(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(self.raw(a, b) + (b - a).astype(np.uint64) * _LENGTH)

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Hash of [a, b) without word i, equal to `whole` of the same words."""
        joined = self.raw(a, i) + self.raw(i + 1, b) * self.power[i - a]
        return mixed(joined + (b - a - 1).astype(np.uint64) * _LENGTH)


def lines_of(texts: list[bytes]) -> tuple[pd.DataFrame, Sequences]:
    """Lines with a word: text (its index), line_no, a and b (their words), and the hashes."""
    tokens = tokenize(texts)
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    breaks = np.flatnonzero(buffer == 10)
    line = np.searchsorted(breaks, tokens.start)
    first = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])[:-1]
    a = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    b = np.append(a[1:], len(line)) if len(a) else a
    text = tokens.text[a]
    frame = pd.DataFrame({"text": text, "line_no": line[a] - first[text], "a": a, "b": b})
    return frame, Sequences(tokens.hash)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def halves(seq: Sequences, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """For the classes n and n - 1 of the shorter line's length: hashes of the first c // 2 and
    of the last c - c // 2 words."""
    out = []
    for c in (b - a, b - a - 1):
        cls = c.astype(np.uint64) * _SIDE
        out.append(mixed(seq.whole(a, a + c // 2) + cls))
        out.append(mixed(seq.whole(b - (c - c // 2), b) + cls + np.uint64(1)))
    return out


def scan(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per line with a word, and one per document with line null: id, line_no, line (its
    hash), and the halves' hashes k0 to k3 (null for short lines)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, done = frame["id"].to_numpy(), 0
            for part in chunks(utf8(frame["text"])):
                own = ids[done : done + len(part)]
                done += len(part)
                found, seq = lines_of(part)
                a, b = found["a"].to_numpy(), found["b"].to_numpy()
                long = b - a >= least_words
                out = {
                    "id": own[found["text"]],
                    "line_no": found["line_no"].astype(np.int32),
                    "line": pd.array(signed(seq.whole(a, b)), "Int64"),
                }
                keys = halves(seq, np.where(long, a, 0), np.where(long, b, min(2, len(seq.prefix) - 1)))
                for k, key in enumerate(keys):
                    column = pd.array(signed(key), "Int64")
                    column[~long] = pd.NA
                    out[f"k{k}"] = column
                yield pd.DataFrame(out)
                marks = pd.DataFrame({"id": own, "line_no": np.full(len(own), -1, np.int32)})
                for name in ("line", "k0", "k1", "k2", "k3"):
                    marks[name] = pd.array([pd.NA] * len(own), "Int64")
                yield marks

    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")
    schema = "id long, line_no int, line long, k0 long, k1 long, k2 long, k3 long"
    return fixed(rows.mapInPandas(read, schema))


def distinct_lines(rows: DataFrame) -> DataFrame:
    """line, first (its earliest place) and its keys."""
    keys = [F.max(f"k{k}").alias(f"k{k}") for k in range(4)]
    return (
        rows.filter("line is not null")
        .groupBy("line")
        .agg(F.min(F.struct("id", "line_no")).alias("first"), *keys)
    )


def candidates(lines: DataFrame) -> DataFrame:
    """Lines (line, first) that share a half with another line."""
    keyed = lines.filter("k0 is not null").select(
        "line", "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")
    )
    shared = (
        keyed.groupBy("key")
        .agg(F.min("line").alias("low"), F.max("line").alias("high"))
        .filter("low < high")
        .select("key")
    )
    return keyed.join(shared, "key", "left_semi").select("line", "first").distinct()


def variants(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """line, key, place (-1: the whole line) of all chosen lines, from the documents where they
    stand first."""
    wanted = chosen.groupBy(F.col("first.id").alias("id")).agg(F.collect_set("line").alias("lines"))
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")
    rows = rows.join(broadcast_if_small(fixed(wanted), MOST_BROADCAST), "id")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            picked, done = list(frame["lines"]), 0
            for part in chunks(utf8(frame["text"])):
                own = picked[done : done + len(part)]
                done += len(part)
                found, seq = lines_of(part)
                a, b = found["a"].to_numpy(), found["b"].to_numpy()
                line = signed(seq.whole(a, b))
                cuts = np.searchsorted(found["text"], np.arange(len(part) + 1))
                keep = np.zeros(len(line), bool)
                for i, lines in enumerate(own):
                    span = slice(cuts[i], cuts[i + 1])
                    keep[span] = np.isin(line[span], np.asarray(lines))
                a, b, line = a[keep], b[keep], line[keep]
                size = b - a
                base = np.repeat(a, size)
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                less = signed(seq.without(base, np.repeat(b, size), base + place))
                yield pd.DataFrame({"line": line, "key": line, "place": np.full(len(line), -1, np.int32)})
                yield pd.DataFrame(
                    {"line": np.repeat(line, size), "key": less, "place": place.astype(np.int32)}
                )

    return rows.select("text", "lines").mapInPandas(cut, "line long, key long, place int")


def near(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """line, near_first: the earliest near line of every line that has an earlier one."""
    chosen = fixed(candidates(lines))
    made = fixed(variants(docs, chosen).distinct().join(chosen, "line"))
    least, whole = F.min("first").alias("near_first"), F.col("place") == -1
    several = F.min("line") < F.max("line")
    same = (
        made.filter(~whole).groupBy("key", "place").agg(least, several.alias("_s")).filter("_s").drop("_s")
    )
    full = made.filter(whole).groupBy("key").agg(least)
    less = made.filter(~whole).groupBy("key").agg(least)
    found = [
        made.filter(~whole).join(same, ["key", "place"]),
        made.filter(~whole).join(full, "key"),
        made.filter(whole).join(less, "key"),
    ]
    earlier = [f.filter(F.col("near_first") < F.col("first")).select("line", "near_first") for f in found]
    return earlier[0].union(earlier[1]).union(earlier[2]).groupBy("line").agg(F.min("near_first").alias("near_first"))


def decided(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, line_no, line, why: 'exact', 'near' or null (kept), for every line with a word, and
    a row with line null for every document. A null doc_id is NULL_ID here."""
    rows = scan(docs, least_words)
    lines = distinct_lines(rows)
    # Stored, so that the join below deals both sides out itself and can split a hot line.
    firsts = fixed(lines.select("line", "first").join(near(docs, lines), "line", "left"))
    place = F.struct("id", "line_no")
    why = F.when(F.col("first") < place, "exact").when(F.col("near_first").isNotNull(), "near")
    return rows.join(firsts, "line", "left").select("id", "line_no", "line", why.alias("why"))


def per_document(decisions: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near and the numbers of the lines that go."""
    numbers = lambda when: F.collect_set(F.when(when, F.col("line_no")))
    held = decisions.groupBy("id").agg(
        F.size(numbers(F.col("line").isNotNull())).cast("long").alias("n_lines"),
        F.size(numbers(F.col("why") == "exact")).cast("long").alias("n_exact"),
        F.size(numbers(F.col("why") == "near")).cast("long").alias("n_near"),
        F.array_sort(numbers(F.col("why").isNotNull())).alias("dropped"),
    )
    doc_id = F.when(F.col("id") != NULL_ID, F.col("id"))
    return held.select(doc_id.alias("doc_id"), "n_lines", "n_exact", "n_near", "dropped")


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines numbered in `dropped`; unchanged where that is null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(texts, numbers):
            if t is not None and gone is not None and len(gone):
                gone = set(gone)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            out.append(t)
        return pd.Series(out, dtype=object)

    return cut(text, dropped)


def cleaned(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated lines removed from their text; documents that lose nothing and null
    texts are as they were.

    Here a document is an id with a text: rows that share an id, or have none, lose lines by their
    own text only, ordered by id (null last) and hash of the text. Rows equal in both are one.
    """
    text_key = F.xxhash64("text")
    units = with_position(
        docs.select(F.col("doc_id").alias("_doc"), text_key.alias("_text_key")).distinct(),
        [F.col("_doc").asc_nulls_last(), F.col("_text_key").asc()],
        [],
        "_unit",
    )
    units = broadcast_if_small(fixed(units), MOST_BROADCAST)
    own = docs["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_text_key"))
    keyed = docs.join(units, own)
    found = decided(keyed.select(F.col("_unit").alias("doc_id"), "text"), least_words)
    plan = per_document(found).filter(F.size("dropped") > 0)
    plan = plan.select(F.col("doc_id").alias("_of"), F.col("dropped").alias("_dropped"))
    small = broadcast_if_small(fixed(plan), MOST_BROADCAST)
    joined = keyed.join(small, F.col("_unit") == F.col("_of"), "left")
    text = without_lines(docs["text"], F.col("_dropped"))
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))
