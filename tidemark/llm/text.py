"""Words, lines and sizes of texts, on the JVM and inside tasks.

A word is a run of bytes other than the six ASCII blanks (space, \\t, \\n, \\v, \\f, \\r).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_dir

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(20240101).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
BLANK, LETTER, MARK = 0, 1, 2
#: Class of each byte where only blanks part words.
WORDS = np.full(256, LETTER, np.uint8)
WORDS[[9, 10, 11, 12, 13, 32]] = BLANK
#: Class of each byte where runs of ASCII marks are tokens of their own.
PIECES = WORDS.copy()
PIECES[[b for b in range(128) if WORDS[b] and not chr(b).isalnum()]] = MARK
#: Bytes of text that numpy works on at a time: arrays of some 60 times this size at most,
#: unless one text alone is longer.
CHUNK = 1 << 20


class Tokens(NamedTuple):
    hash: np.ndarray  # uint64, one per token
    text: np.ndarray  # int64, the index of its text
    start: np.ndarray  # int64, first byte in the joined buffer
    end: np.ndarray  # int64, behind the last byte


def word_count(text: Column) -> Column:
    """Number of words as long; null counts 0. One character per word is left and counted,
    so that a very long text makes no array of its words."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]", "")), F.lit(0)).cast("long")


def utf8(texts) -> list[bytes]:
    """The UTF-8 bytes of a pandas Series of texts; null is empty."""
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    """The texts in lists of about `most` bytes; a longer text comes alone and whole."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def tokenize(texts: list[bytes], classes: np.ndarray = WORDS) -> Tokens:
    """Hashes (64 bit) of all tokens of some texts. Equal tokens have equal hashes; two
    different ones share a hash with a chance of about 2**-64."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = classes[buffer]
    fresh = np.empty(len(kind), bool)
    fresh[0] = kind[0] != BLANK
    np.logical_and(kind[1:] != kind[:-1], kind[1:] != BLANK, out=fresh[1:])
    start = np.flatnonzero(fresh)
    size = np.array([len(t) + 1 for t in texts])
    text = np.searchsorted(np.cumsum(size), start, "right")
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint64), none, none, none)
    over = np.flatnonzero(kind[:-1] != kind[1:]) + 1  # the last byte is a blank
    end = over[np.searchsorted(over, start, "right")]
    power = np.full(int((end - start).max()) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inside = np.flatnonzero(kind)
    offset = inside - np.repeat(start, end - start)
    value = _VALUE[buffer[inside]] * power[offset]
    length = np.cumsum(end - start)
    found = np.add.reduceat(value, np.concatenate([[0], length[:-1]]))
    return Tokens(mixed(found), text, start, end)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows whose labels are never learnt from; a null id is not held out."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % folds == 0, F.lit(False))


def fixed(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
