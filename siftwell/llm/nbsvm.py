"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are byte n-grams of up to four bytes and the repetition shape of word six-grams.
For every n-gram f the ratio r_f = log((a + n_f1) / sum) - log((a + n_f0) / sum) weighs its
indicator.  A linear support vector machine is fitted on the scaled indicators by dual coordinate
descent; margins become probabilities by a logistic curve fitted on out-of-fold margins.

Defined cases
    null or empty text: scored by the intercept.  null doc_id: kept, held_out null, never
    learned from.  Repeated rows: each scored; a doc_id with several label rows counts with its
    largest label.  No usable label rows, or one class only: every score is the share of ones
    (0.5 without labels).  Empty table: no rows.  Extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.features import Hasher, collect_sample, labelled_sample, score_documents

HASHER = Hasher(orders=(1, 2, 3, 4, -1), bits=18, lower=False)
#: Bound on the labelled rows that a model is fitted on.
MAX_TRAINING_ROWS = 4000


def log_count_ratio(ids: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, size), smooth)
    for x, label in zip(ids, y, strict=True):
        counts[label, x] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1]) - np.log(counts[0])


def dual_coordinate_descent(ids: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights (already multiplied by the ratio) and intercept."""
    sign, w, b = np.where(y == 1, 1.0, -1.0), np.zeros(len(ratio)), 0.0
    scaled = ratio.astype(np.float64)
    norm = np.array([np.dot(scaled[x], scaled[x]) + 1.0 for x in ids])
    alpha, rng = np.zeros(len(ids)), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(ids)):
            x = ids[i]
            v = scaled[x]
            gradient = sign[i] * (np.dot(w[x], v) + b) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x] += step * v
                b += step
                worst = max(worst, abs(step) * norm[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    return w * scaled, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve sigma(a * margin + b) by Newton steps on smoothed targets."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([np.dot(p - target, margin), (p - target).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.dot(q, margin * margin), np.dot(q, margin)], [np.dot(q, margin), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(ids: list[np.ndarray], y: np.ndarray, size: int, folds: int = 3) -> tuple[np.ndarray, float]:
    """Weight table and intercept of the calibrated log-odds."""
    ones = int(y.sum())
    if ones in (0, len(y)):
        share = min(max((ones + 0.5) / (len(y) + 1), 0.01), 0.99)
        return np.zeros(size), float(np.log(share / (1 - share)))
    fold, margin = np.arange(len(y)) % folds, np.zeros(len(y))

    def train(rows):
        some, labels = [ids[i] for i in rows], y[rows]
        ratio = log_count_ratio(some, labels, size)
        return dual_coordinate_descent(some, labels, ratio / max(np.sqrt(np.mean([np.dot(ratio[x], ratio[x]) for x in some])), 1e-9))

    for f in range(folds):
        rows, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(set(y[rows].tolist())) == 2:
            w, b = train(rows)
            for i in rest:
                margin[i] = w[ids[i]].sum() + b
    w, b = train(np.arange(len(y)))
    slope, shift = platt(margin, y)
    return w * slope, b * slope + shift


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, max_rows: int = MAX_TRAINING_ROWS, hasher: Hasher = HASHER, extra: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """doc_id, held_out, score, predicted (and extra columns of docs) for every row of docs.

    prefix goes before the names of the three new columns, should extra columns clash with them.
    Learns only from labelled rows whose crc32(doc_id as text) modulo folds is not 0.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    sample = labelled_sample(docs, labels, max_rows, allowed=remainder != 0, columns=("quality",))
    ids, got = collect_sample(sample, hasher, ["quality", "doc_id"])
    w, b = fit(ids, got["quality"], hasher.size)
    del ids, got
    pa.default_memory_pool().release_unused()

    def finish(sums: np.ndarray):
        score = 1 / (1 + np.exp(-np.clip(sums[:, 0] + b, -40, 40)))
        return [score, (score >= threshold).astype(np.int32)]

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    # the text column itself may be kept: it is then returned as it came in
    rows = docs.select(F.col("doc_id"), "text", (remainder == 0).alias(f"{prefix}held_out"), *(F.col(c) for c in extra if c != "text"))
    keep = ["doc_id", f"{prefix}held_out", *extra]
    kinds = {"doc_id": types["doc_id"], f"{prefix}held_out": "boolean"} | {c: types[c] for c in extra}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"`{prefix}score` double", f"`{prefix}predicted` int"])
    return score_documents(rows, hasher, w.astype(np.float64)[:, None], finish, [f"{prefix}score", f"{prefix}predicted"], schema, keep)
