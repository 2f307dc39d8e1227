"""Quality by logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Features are the distinct words, word pairs and coarse shapes (length, repetition, capitals)
of a whole text, hashed to 2**BITS places; a row is scaled to length 1. At most `most_labelled`
labelled documents train the model; everything is scored without any bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.classify import Model, first_ids, sample, score
from tidemark.llm.linear import Rows, follow_the_leader
from tidemark.llm.text import held_out

BITS = 18


def fit(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 12_000, folds: int = 5) -> Model:
    """Train on docs (doc_id, text) and labels (doc_id, quality), leaving out one fold of ids.

    Null ids and null labels are not learnt from; an id that is labelled both ways is learnt
    both ways. Without labels every score is 0.5.
    """
    known = labels.filter("quality in (0, 1)").filter(~held_out(F.col("doc_id"), folds))
    chosen = first_ids(known.select("doc_id"), most_labelled)
    ids = (
        known.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.col("quality").cast("string").alias("role"))
        .distinct()
    )
    rows = sample(docs, ids, BITS, True, True)
    weights, bias = follow_the_leader(
        Rows.of([x for _, x in rows]),
        np.array([int(role) for role, _ in rows], float),
        1 << BITS,
        alpha=2.0,
        l1=0.05,
        l2=0.0,
        epochs=4,
    )
    return Model(weights.astype(np.float32), bias, BITS, True, True, True)


def scored(docs: DataFrame, model: Model, out: str = "quality") -> DataFrame:
    """docs with a score column; other columns pass through unseen."""
    return docs.withColumn(out, score(model, docs["text"]))
