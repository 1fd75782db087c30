"""Quality by naive Bayes support vectors.

Indicators of token n-grams (and of n-grams of token shapes: case, digits,
punctuation, equal to the token before) are scaled by the log ratio of their
class frequencies, and a linear hinge-loss model is fitted to the scaled rows
by dual coordinate descent. Margins become probabilities by a logistic curve
that is fitted to rows the support vectors have not seen.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm import features as X

BITS = 20
SIZE = (1 << BITS) + X.SHAPE_SPACE
#: Smoothing of the counts, least rows with a feature, penalty of the hinge loss, passes.
SMOOTH, LEAST_ROWS, C, EPOCHS = 1.0, 3, 1.0, 12
#: At most so many labelled rows are fitted on; every CALIBRATE-th is kept for the curve.
MOST_ROWS, CALIBRATE = 12_000, 5
FOLD, SEED, CUT = (5, 0), 9, 0.3


class Model(NamedTuple):
    """``weights`` and ``scales`` are for the numbers ``at``; see :func:`margin`."""

    at: np.ndarray
    weights: np.ndarray
    scales: np.ndarray
    bias: float
    slope: float
    offset: float


def extract(text: str | None) -> np.ndarray:
    return X.token_grams(text, BITS)


def log_ratios(xs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed row counts p, q of the classes;
    zero for features of fewer than LEAST_ROWS rows."""
    count = [np.bincount(np.concatenate([np.zeros(0, np.int64), *[x for x, k in zip(xs, y) if k == c]]), minlength=SIZE).astype(float) for c in (0, 1)]
    p, q = count[1] + SMOOTH, count[0] + SMOOTH
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(count[0] + count[1] >= LEAST_ROWS, r, 0.0)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: one dual variable at a time is
    set to its best value in [0, C], the weights following."""
    w, bias, rng = np.zeros(SIZE), 0.0, np.random.default_rng(SEED)
    dual = np.zeros(len(rows))
    for _ in range(EPOCHS):
        change = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = sign[i] * (w[at] @ v + bias) - 1.0
            best = min(max(dual[i] - gradient / (v @ v + 1.0), 0.0), C)
            step = best - dual[i]
            if step:
                w[at] += step * sign[i] * v
                bias += step * sign[i]
                dual[i] = best
                change = max(change, abs(step))
        if change < 1e-3:
            break
    return w, bias


def scaled(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero features of a row, scaled and brought to length one."""
    v = r[x]
    at = v != 0
    x, v = x[at], v[at]
    return x, v / max(np.sqrt(v @ v), 1e-12)


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of P(1) = sigmoid(slope * margin + offset) by Newton's
    steps on smoothed targets; a falling curve is never returned."""
    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, h = p - target, p * (1 - p) + 1e-9
        ga, gb = (d * margins).sum() + 1e-3 * a, d.sum()
        haa, hab, hbb = (h * margins * margins).sum() + 1e-3, (h * margins).sum(), h.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(xs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights, then scales, of the features with a scale, and (bias, slope,
    offset). Without rows of both classes: none, and the smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    kept = np.arange(len(y)) % CALIBRATE == 0
    if not len(y) or any(len(set(y[k].tolist())) < 2 for k in (kept, ~kept)):
        return np.zeros(0, np.int64), np.zeros(0), [0.0, 1.0, float(np.log(share / (1 - share)))]
    seen = [x for x, k in zip(xs, kept) if not k]
    r = log_ratios(seen, y[~kept])
    w, bias = dual_descent([scaled(x, r) for x in seen], 2.0 * y[~kept] - 1)
    margins = np.array([w[at] @ v + bias for at, v in (scaled(x, r) for x, k in zip(xs, kept) if k)])
    slope, offset = logistic_curve(margins, y[kept])
    at = np.flatnonzero(r)
    return at, np.concatenate([w[at], r[at]]), [bias, slope, offset]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = MOST_ROWS) -> Model:
    """Fit on at most ``most`` labelled ids outside the held-out fold (of repeated
    ids and labels see :func:`features.training_sample`)."""
    sample = X.training_sample(docs, labels, label, FOLD, most, SEED, extract, id_col, text_col)
    at, both, (bias, slope, offset) = X.fit_in_task(sample, fit)
    return Model(at, both[:len(at)], both[len(at):], bias, slope, offset)


def _scorer(docs: DataFrame, model: Model):
    """Text -> score, with the weights broadcast and unpacked once in each worker."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list = []

    def apply(text: str | None) -> float:
        if not made:
            m = shared.value
            w, r = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
            w[m.at], r[m.at] = m.weights, m.scales
            made.append((w, r, m))
        w, r, m = made[0]
        at, v = scaled(extract(text), r)
        return X.sigmoid(m.slope * (float(w[at] @ v) + m.bias) + m.offset)

    return apply


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` in (0, 1), ``predicted`` (score at
    least CUT), one row per input row, repeated rows too.

    A null or empty text has no features and is scored by the bias; null ids
    are passed on and aren't held out. Other columns are ignored. Nothing but
    the text enters the score.
    """
    out = X.scored(docs, _scorer(docs, model), id_col, text_col)
    return out.select("doc_id", X.held_out(F.col("doc_id"), FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`score` predicts 1 for, all columns as they
    are; no shuffle, since each row is decided where it is read."""
    scorer = _scorer(docs, model)
    return X.accepted(docs, lambda text: scorer(text) >= CUT, text_col)
