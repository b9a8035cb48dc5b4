"""Toxicity by classifier chains.

Categories are predicted one after the other by linear (logistic) models over hashed words and
byte n-grams.  Each model also sees the probabilities of all earlier categories; in training these
come from out-of-fold predictions, so a later model learns from what an earlier one gives on
texts that it has not seen.  A link uses the features whose presence differs significantly between
its classes (LEAST_Z, LEAST_COUNT), however many they are.  It is fitted on the driver, on at most
max_rows labelled rows and features.SAMPLE_BYTES of their ids.

Defined cases
    null or empty text: scored by the intercepts.  null doc_id: kept.  Repeated rows: each scored;
    a doc_id with several label rows counts with its largest label.  A category without both
    classes in the sample: constant at its share (0.5 without labels).  Empty table: no rows.
    Extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.features import Hasher, collect_sample, labelled_sample, score_documents

HASHER = Hasher(orders=(0, 5), bits=19, lower=True)
#: Bound on the labelled rows that the chain is fitted on.
MAX_TRAINING_ROWS = 6000
#: A feature counts from this two-proportion z score and this number of rows on.
LEAST_Z, LEAST_COUNT = 4.0, 3


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


class Sparse:
    """Presence rows as one id array with row edges, and dense columns beside them."""

    def __init__(self, ids: list[np.ndarray], dense: np.ndarray):
        self.n = np.array([len(x) for x in ids])
        self.flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(ids)), self.n)
        self.dense = dense


def logistic(data: Sparse, y: np.ndarray, size: int, steps: int = 150, rate: float = 0.1, decay: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, dense weights and intercept by Adam on the penalised log loss."""
    k = data.dense.shape[1]
    w, m, v = np.zeros(size + k + 1), np.zeros(size + k + 1), np.zeros(size + k + 1)
    weight = 1 / len(y)
    for t in range(1, steps + 1):
        z = np.bincount(data.row, weights=w[data.flat], minlength=len(y)) + data.dense @ w[size : size + k] + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gradient = np.concatenate([np.bincount(data.flat, weights=g[data.row], minlength=size), data.dense.T @ g, [g.sum()]])
        gradient[:-1] += decay * w[:-1] / len(y)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient * gradient
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:size], w[size : size + k], float(w[-1])


def informative(ids: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Features whose presence differs significantly between the classes."""
    ones = max(int(y.sum()), 1)
    zeros = max(len(y) - ones, 1)
    a = np.bincount(np.concatenate([x for x, t in zip(ids, y, strict=True) if t] or [np.zeros(0, np.int64)]), minlength=size)
    total = np.bincount(np.concatenate(ids), minlength=size)
    p = total / len(y)
    z = (a / ones - (total - a) / zeros) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / ones + 1 / zeros))
    return np.flatnonzero((total >= LEAST_COUNT) & (np.abs(z) >= LEAST_Z))


def train_link(ids: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """A logistic model on this category's informative features; weights in the full table."""
    chosen = informative(ids, y, size)
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    some = [p[p >= 0] for p in (place[x] for x in ids)]
    w, d, b = logistic(Sparse(some, earlier), y, len(chosen))
    table = np.zeros(size)
    table[chosen] = w
    return table, d, b


def fit_chain(ids: list[np.ndarray], labels: list[np.ndarray], size: int, folds: int = 3) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One (weights, weights of earlier probabilities, intercept) per category, in order."""
    n = len(ids)
    fold, earlier, chain = np.arange(n) % folds, np.zeros((n, 0)), []
    for y in labels:
        if not n or y.min() == y.max():
            share = min(max((y.sum() + 0.5) / (n + 1), 0.01), 0.99)
            w, d, b = np.zeros(size), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share)))
            odds = np.full(n, b)
        else:
            odds = np.zeros(n)
            for f in range(folds):
                a, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                w, d, b = train_link([ids[i] for i in a], earlier[a], y[a], size)
                for i in rest:
                    odds[i] = w[ids[i]].sum() + earlier[i] @ d + b
            w, d, b = train_link(ids, earlier, y, size)
        chain.append((w, d, b))
        earlier = np.concatenate([earlier, probability(odds)[:, None]], 1)
    return chain


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], threshold: float = 0.5, max_rows: int = MAX_TRAINING_ROWS, hasher: Hasher = HASHER, label: str = "toxic", keep: tuple[str, ...] = ("lang",), main: str | None = None) -> DataFrame:
    """doc_id, one probability per category in chain order, and predicted for the main one (the last, if none is named).

    categories maps each name to a 0/1 expression over the labelled rows (label column and the
    keep columns); it is evaluated on the training sample only.
    """
    names = list(categories)
    chosen = names.index(main) if main else len(names) - 1
    sample = labelled_sample(docs, labels, max_rows, columns=(label,), keep=keep)
    sample = sample.select("doc_id", "text", *(F.coalesce(c.cast("int"), F.lit(0)).alias(f"category_{i}") for i, c in enumerate(categories.values())))
    ids, got = collect_sample(sample, hasher, [*(f"category_{i}" for i in range(len(names))), "doc_id"])
    chain = fit_chain(ids, [got[f"category_{i}"] for i in range(len(names))], hasher.size)
    table = np.stack([w for w, _, _ in chain], 1).astype(np.float32)
    later = [(d, b) for _, d, b in chain]

    def finish(sums: np.ndarray):
        p: list[np.ndarray] = []
        for i, (d, b) in enumerate(later):
            p.append(probability(sums[:, i] + b + sum((q * x for q, x in zip(p, d, strict=True)), np.zeros(len(sums)))))
        return [*p, (p[chosen] >= threshold).astype(np.int32)]

    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}["doc_id"]
    columns = [*names, "predicted"]
    return score_documents(docs.select("doc_id", "text"), hasher, table, finish, columns, ", ".join([f"doc_id {kind}", *(f"`{n}` double" for n in names), "predicted int"]), ["doc_id"])
