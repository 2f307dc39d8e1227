"""Linear classifiers over sparse binary features, trained with numpy on a bounded sample."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Rows(NamedTuple):
    """Sparse binary rows: row i holds the features index[start[i]:start[i + 1]]."""

    index: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        sizes = np.array([len(r) for r in rows], np.int64)
        index = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        return cls(index, np.concatenate([[0], np.cumsum(sizes)]))

    def row(self, i: int) -> np.ndarray:
        return self.index[self.start[i] : self.start[i + 1]]

    def take(self, picked: np.ndarray) -> Rows:
        return Rows.of([self.row(i) for i in picked])

    def only(self, kept: np.ndarray) -> Rows:
        """The same rows with the features that are kept."""
        owner, held = self.owner(), kept[self.index]
        sizes = np.bincount(owner[held], minlength=len(self))
        return Rows(self.index[held], np.concatenate([[0], np.cumsum(sizes)]))

    def __len__(self) -> int:
        return len(self.start) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))


def scale(n):
    """The value of each of the n features of a text, so that its row has length 1."""
    return 1 / np.sqrt(np.maximum(n, 1))


def sums(weights: np.ndarray, at: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
    """Sparse dot products with rows of ones, one per text."""
    return np.bincount(at, weights[feature], texts)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def follow_the_leader(
    rows: Rows,
    labels: np.ndarray,
    dims: int,
    *,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 1.0,
    epochs: int = 4,
    seed: int = 1,
) -> tuple[np.ndarray, float]:
    """Logistic regression by follow-the-regularised-leader (proximal) updates, one example
    after the other. Returns weights and bias; the bias is the last coordinate and is not
    regularised by l1."""
    z, n, w = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own = rows.row(i)
            at = np.append(own, dims)
            x = np.append(np.full(len(own), scale(len(own))), 1.0)
            zi, ni = z[at], n[at]
            lasso = np.full(len(at), l1)
            lasso[-1] = 0
            wi = np.where(
                np.abs(zi) <= lasso,
                0.0,
                (np.sign(zi) * lasso - zi) / ((beta + np.sqrt(ni)) / alpha + l2),
            )
            g = (sigmoid(wi @ x) - labels[i]) * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * wi
            n[at] = grown
    lasso = np.full(dims + 1, l1)
    lasso[-1] = 0
    rate = (beta + np.sqrt(n)) / alpha + l2
    w = np.where(np.abs(z) <= lasso, 0.0, (np.sign(z) * lasso - z) / rate)
    return w[:-1], float(w[-1])


def nonnegative_pu(
    positive: Rows,
    unlabelled: Rows,
    dims: int,
    prior: float,
    *,
    rate: float = 0.02,
    l2: float = 1e-4,
    epochs: int = 30,
    batch: int = 256,
    slack: float = 0.0,
    seed: int = 1,
) -> tuple[np.ndarray, float]:
    """Non-negative positive-unlabelled learning with the logistic loss and Adam.

    The risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]). Where a batch's
    estimate of the negative part falls below -slack, the step goes against that part's
    gradient instead, so that the model cannot gain from a negative risk.
    """
    w, b = np.zeros(dims), 0.0
    m, v, mb, vb, t = np.zeros(dims), np.zeros(dims), 0.0, 0.0, 0
    order = np.random.default_rng(seed)
    steps = max(1, -(-len(unlabelled) // batch))
    part = max(1, min(batch, len(positive)))

    def run(rows: Rows):
        return sums(w, rows.owner(), rows.index, len(rows)) + b

    def grad(rows: Rows, by: np.ndarray):
        each = np.repeat(by, np.diff(rows.start))
        return np.bincount(rows.index, each, dims), by.sum()

    for _ in range(epochs):
        shuffled = order.permutation(len(unlabelled))
        for s in range(steps):
            u = unlabelled.take(shuffled[s * batch : (s + 1) * batch])
            p = positive.take(order.integers(0, len(positive), part))
            fp, fu = run(p), run(u)
            minus = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gu, bu = grad(u, sigmoid(fu) / len(fu))
            gn, bn = grad(p, sigmoid(fp) / len(fp))
            g, gb = gu - prior * gn, bu - prior * bn
            if minus < -slack:
                g, gb = -g, -gb
            else:
                gp, bp = grad(p, -sigmoid(-fp) / len(fp))
                g, gb = g + prior * gp, gb + prior * bp
            g = g + l2 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= step * m / (np.sqrt(v) + 1e-8)
            b -= step * mb / (np.sqrt(vb) + 1e-8)
    return w, b
