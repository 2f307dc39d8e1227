"""What both text classifiers share: a bounded sample with features, and scoring."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import sigmoid, sums
from tidemark.llm.ngrams import features
from tidemark.llm.text import chunks, utf8


class Model(NamedTuple):
    weights: np.ndarray  # one for each of 2**bits features
    bias: float
    bits: int
    with_pairs: bool
    with_shapes: bool
    unit_rows: bool  # rows are scaled to length 1


def first_ids(ids: DataFrame, most: int, **more) -> DataFrame:
    """`most` ids in the order of their hash, with constant columns; the bound of a sample."""
    ids = ids.filter("doc_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return ids.select("doc_id", *(F.lit(v).alias(k) for k, v in more.items()))


def sample(
    docs: DataFrame, ids: DataFrame, bits: int, with_pairs: bool, with_shapes: bool
) -> list[tuple[str, np.ndarray]]:
    """(role, features) of the chosen documents, whole texts; ids (doc_id, role) is bounded by
    `first_ids`, so it is broadcast and its features are brought to the driver."""
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    texts = texts.dropDuplicates(["doc_id", "role"]).withColumn("doc_id", F.col("doc_id").cast("string"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, done = [], 0
            for part in chunks(utf8(frame["text"])):
                at, feature = features(part, bits, with_pairs, with_shapes)
                cuts = np.searchsorted(at, np.arange(len(part) + 1))
                for i in range(len(part)):
                    own = feature[cuts[i] : cuts[i + 1]].astype(np.int32)
                    rows.append((frame["doc_id"].iloc[done + i], frame["role"].iloc[done + i], own.tobytes()))
                done += len(part)
            yield pd.DataFrame(rows, columns=["doc_id", "role", "features"])

    found = texts.mapInPandas(encode, "doc_id string, role string, features binary").collect()
    found.sort(key=lambda r: (r.role, r.doc_id))  # the order of arrival must not matter
    return [(r.role, np.frombuffer(r.features, np.int32)) for r in found]


def score(model: Model, text: Column) -> Column:
    """Probability-like score of a text for the label 1, in [0, 1]. Null or empty text has the
    score of the bias (and of its shapes, if the model knows them)."""
    weights, bias, bits = model.weights, model.bias, model.bits
    pairs, shapes, unit = model.with_pairs, model.with_shapes, model.unit_rows

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = []
        for part in chunks(utf8(texts)):
            at, feature = features(part, bits, pairs, shapes)
            z = sums(weights, at, feature, len(part))
            if unit:
                z = z / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(part))))
            out.append(sigmoid(z + bias))
        return pd.Series(np.concatenate([*out, np.zeros(0)]))

    return scored(text)
