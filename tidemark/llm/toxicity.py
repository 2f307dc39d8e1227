"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are learnt from; the share of toxic text
(the class prior) corrects the risk estimate. Features are hashed words. Those that toxic
examples have at least `lift` times as often as unlabelled text take part, so that a few
thousand examples are not learnt by heart. Where labels of both kinds exist, the decision is
calibrated on all labelled documents outside the held-out fold: of the cuts above 0, that with the
fewest wrong decisions, so that no share of the corpus is forced beyond it. Labels of one kind need
a given `prior`; then the cut has at most that share of all documents beyond it. Either way a text
whose words tell nothing scores below 0.5.

Bounds: at most `most_positive` toxic and `most_unlabelled` unlabelled documents train the
model. Everything is scored, whole texts, without any bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.classify import Model, first_ids, sample, score
from tidemark.llm.linear import Rows, nonnegative_pu, sums
from tidemark.llm.text import held_out

BITS = 18
STEP = 0.01


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    most_positive: int = 3000,
    most_unlabelled: int = 10_000,
    least_share: float = 0.02,
    lift: float = 3.0,
    prior: float | None = None,
    folds: int = 5,
) -> Model:
    """Train on docs (doc_id, text) and labels (doc_id, toxic), leaving out one fold of ids.

    prior: share of toxic text; if not given, that of the labels outside the held-out fold.
    Without any toxic example the model scores every text 0 (as far as a double can).
    Null ids, null labels and repeated ids: the first two are not learnt from, the third once.
    """
    known = labels.filter("toxic is not null").filter(~held_out(F.col("doc_id"), folds))
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    toxic = first_ids(known.filter("toxic = 1").select("doc_id"), most_positive, role="p")
    others = docs.select("doc_id").filter(~held_out(F.col("doc_id"), folds))
    ids = toxic.union(first_ids(others, most_unlabelled, role="u"))
    rows = sample(docs, ids, BITS, False, False)
    positive = Rows.of([x for role, x in rows if role == "p"])
    unlabelled = Rows.of([x for role, x in rows if role == "u"])
    model = train(positive, unlabelled, prior, least_share, lift)
    return calibrated(model, docs, known, prior) if model.weights.any() else model


def train(
    positive: Rows, unlabelled: Rows, prior: float, least_share: float, lift: float
) -> Model:
    dims = 1 << BITS
    if not len(positive) or not len(unlabelled) or not 0 < prior < 1:
        return Model(np.zeros(dims, np.float32), -35.0, BITS, False, False, False)
    in_toxic = np.bincount(positive.index, minlength=dims)
    in_all = np.bincount(unlabelled.index, minlength=dims)
    telling = in_toxic >= max(3, least_share * len(positive))
    telling &= in_toxic / len(positive) >= lift * in_all / len(unlabelled)
    positive, unlabelled = positive.only(telling), unlabelled.only(telling)
    weights, _ = nonnegative_pu(positive, unlabelled, dims, prior, rate=0.02, epochs=10)
    # The cut of the sample; `fit` replaces it.
    values, count = np.unique(sums(weights, unlabelled.owner(), unlabelled.index, len(unlabelled)), return_counts=True)
    return Model(weights.astype(np.float32), -share_cut(values, count, prior), BITS, False, False, False)


def calibrated(model: Model, docs: DataFrame, known: DataFrame, prior: float) -> Model:
    """The model with the cut that decides most of the documents of known (doc_id, toxic) right;
    without two kinds of them, with that of the share `prior` of all documents.
    The driver sees counts for sums rounded to STEP; sums beyond +-27 count as that."""
    own = docs.select("doc_id", score(model._replace(bias=0.0), docs["text"]).alias("_p"))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("_p")))
    found = own.withColumn("_z", F.round(F.ln(p / (1 - p)) / STEP).cast("int")).drop("_p")
    known = known.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).distinct()
    once = found.join(known, "doc_id").groupBy("doc_id", "_toxic").agg(F.max("_z").alias("_z"))
    toxic = F.sum(F.when(F.col("_toxic") == 1, 1).otherwise(0))
    rows = once.groupBy("_z").agg(toxic.alias("toxic"), F.count("*").alias("all")).orderBy("_z").collect()
    values, ones, every = (np.array([r[c] for r in rows], np.int64) for c in ("_z", "toxic", "all"))
    if 0 < ones.sum() < every.sum():
        return model._replace(bias=-cut(values * STEP, 2 * ones - every))
    rows = found.groupBy("_z").agg(F.count("*").alias("all")).orderBy("_z").collect()
    values, every = (np.array([r[c] for r in rows], np.int64) for c in ("_z", "all"))
    return model._replace(bias=-share_cut(values * STEP, every, prior))


def cut(values: np.ndarray, gain: np.ndarray) -> float:
    """The cut above 0, midway between two neighbouring values, with the largest sum of gains
    from it on, the highest of several; values ascend. Beyond all values if no sum is above 0."""
    upper = np.append(values, max(values[-1], 0.0) + 2 * STEP) if len(values) else np.array([2 * STEP])
    lower = np.maximum(np.append(0.0, values), 0.0)
    total = np.append(np.cumsum(gain[::-1])[::-1], 0)
    fit = np.flatnonzero(upper > 0)[::-1]
    best = fit[np.argmax(total[fit])]
    return float((upper[best] + lower[best]) / 2)


def share_cut(values: np.ndarray, count: np.ndarray, share: float) -> float:
    """The lowest cut above 0 with at most this share of the counts from it on."""
    beyond = np.cumsum(count[::-1])[::-1] <= share * count.sum()
    return cut(values, np.where(beyond, 1, -len(values) - 1))


def scored(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """docs with a score column; other columns pass through unseen."""
    return docs.withColumn(out, score(model, docs["text"]))
