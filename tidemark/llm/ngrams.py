"""Hashed word n-grams of whole texts, as used by both classifiers."""

from __future__ import annotations

import numpy as np

from tidemark.llm.text import PIECES, mixed, tokenize

_PAIR, _SHAPE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shapes(texts: list[bytes], tokens, distinct: np.ndarray) -> np.ndarray:
    """What single words do not show, as four small numbers a text: length, share of fresh
    word pairs, of capitals, and of fresh lines."""
    n = np.bincount(tokens.text, minlength=len(texts))
    fresh = 20 * distinct / np.maximum(1, n - 1)
    out = np.empty((len(texts), 4), np.int64)
    out[:, 0] = 2 * np.log2(n + 1)
    out[:, 1] = np.minimum(fresh, 20)
    for i, text in enumerate(texts):
        capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lines = [x for x in text.split(b"\n") if x]
        out[i, 2] = 20 * capitals // max(1, len(text))
        out[i, 3] = 10 * len(set(lines)) // max(1, len(lines))
    return out


def features(
    texts: list[bytes], bits: int, with_pairs: bool = True, with_shapes: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words and, as asked, word pairs and shapes of each text: (index of
    the text, feature below 2**bits), sorted."""
    tokens = tokenize(texts, PIECES)
    low = np.uint64(64 - bits)
    inner = tokens.text[1:] == tokens.text[:-1]
    pairs = mixed(tokens.hash[:-1] * _PAIR + tokens.hash[1:])[inner]
    at, feature = [tokens.text], [tokens.hash >> low]
    if with_pairs:
        at.append(tokens.text[1:][inner])
        feature.append(pairs >> low)
    if with_shapes:
        held = np.sort(tokens.text[1:][inner].astype(np.uint64) << np.uint64(44) | pairs >> np.uint64(20))
        held = held[np.diff(held, prepend=np.uint64(1 << 63)) != 0]
        distinct = np.bincount((held >> np.uint64(44)).astype(np.int64), minlength=len(texts))
        seen = shapes(texts, tokens, distinct)
        codes = mixed((seen * 4 + np.arange(4)).astype(np.uint64) * _SHAPE + np.uint64(1))
        at.append(np.repeat(np.arange(len(texts)), 4))
        feature.append(codes.ravel() >> low)
    key = np.concatenate(at).astype(np.uint64) << np.uint64(bits) | np.concatenate(feature)
    key.sort()
    key = key[np.diff(key, prepend=np.uint64(1 << 63)) != 0]
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
