"""Toxicity by FTRL-proximal logistic regression over hashed words (and their
first letters, which join the forms of a word), word pairs
and skip pairs.

Every coordinate has its own learning rate, which falls with the gradients it
has seen, and L1 keeps a weight at exactly zero until its gradients outweigh
it, so the fitted weights are few and small to broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm import features as X

BITS = 20
#: Learning rate and its offset, L1 and L2, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 3.0, 0.1, 3
#: At most so many labelled rows are fitted on.
MOST_ROWS = 12_000
FOLD, SEED, CUT = (4, 2), 4, 0.3


class Model(NamedTuple):
    at: np.ndarray
    weights: np.ndarray
    bias: float


def extract(text: str | None) -> np.ndarray:
    return X.skip_grams(text, BITS)


def fit(xs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """FTRL-proximal on indicator vectors ``xs``; the bias has no penalty.
    Without rows of both classes the bias alone gives the smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.int32), np.zeros(0, np.float32), [bias]
    z, n, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            x = xs[i]
            w = weights(z[x], n[x])
            g = X.sigmoid(bias + w.sum()) - y[i]
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at], [bias]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = MOST_ROWS) -> Model:
    """Fit on at most ``most`` labelled ids outside the held-out fold (of repeated
    ids and labels see :func:`features.training_sample`)."""
    sample = X.training_sample(docs, labels, label, FOLD, most, SEED, extract, id_col, text_col)
    at, w, (bias,) = X.fit_in_task(sample, fit)
    return Model(at, w, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` in (0, 1), ``predicted`` (score at
    least CUT), one row per input row, repeated rows too.

    A null or empty text is scored by the bias alone; null ids are passed on
    and aren't held out. Other columns are ignored. Nothing but the text enters
    the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.at, model.weights, model.bias))
    made: list = []

    def apply(text: str | None) -> float:
        if not made:  # once in each worker
            at, w, bias = shared.value
            dense = np.zeros(1 << BITS, np.float32)
            dense[at] = w
            made.append((dense, bias))
        dense, bias = made[0]
        return X.sigmoid(bias + float(dense[extract(text)].sum(dtype=np.float64)))

    out = X.scored(docs, apply, id_col, text_col)
    return out.select("doc_id", X.held_out(F.col("doc_id"), FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
