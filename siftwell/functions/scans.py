"""Running folds over array columns, one pass per sequence, in Arrow batches.

Spark's own ``aggregate`` copies the array that it builds at every step, which is quadratic in a
sequence's length.  Here all sequences of a batch advance together, one NumPy step per place, so
the work is linear in the number of elements and nothing is padded.  A null array gives null; a
null element counts as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), 0.0)), np.r_[0, np.cumsum(lengths)]


def _lists(values: np.ndarray, edges: np.ndarray, like: pa.Array, kind: pa.DataType) -> pa.Array:
    nulls = pc.is_null(like) if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind), mask=nulls)


def _together(columns: tuple[pa.Array, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [_flat(c) for c in columns]
    if any((e != parts[0][1]).any() for _, e in parts[1:]):
        raise ValueError("arrays of a row differ in length")
    return [v for v, _ in parts], parts[0][1]


def places(edges: np.ndarray, backward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step the sequences that still have an element and that element's place in the flat values."""
    lengths = np.diff(edges)
    order = np.argsort(-lengths, kind="stable")
    live = len(order) - np.searchsorted(np.sort(lengths), np.arange(1, lengths.max(initial=0) + 1))
    for t, k in enumerate(live.tolist()):
        rows = order[:k]
        yield rows, (edges[rows + 1] - 1 - t if backward else edges[rows] + t)


def reversed_sums(values: pa.Array) -> pa.Array:
    (v,), edges = _together((values,))
    out, run = np.empty(len(v)), np.zeros(len(edges) - 1)
    for rows, at in places(edges, backward=True):
        run[rows] = out[at] = run[rows] + v[at]
    return _lists(out, edges, values, pa.float64())


def discounted(gamma: float) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def fold(rewards: pa.Array, mask: pa.Array) -> pa.Array:
        (r, m), edges = _together((rewards, mask))
        out, run = np.empty(len(r)), np.zeros(len(edges) - 1)
        for rows, at in places(edges, backward=True):
            out[at] = r[at] + gamma * run[rows]
            run[rows] = out[at] * m[at]
        return _lists(out, edges, rewards, pa.float64())

    return fold


def advantages(gamma: float, lam: float) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    def fold(rewards: pa.Array, values: pa.Array, mask: pa.Array) -> pa.Array:
        (r, v, m), edges = _together((rewards, values, mask))
        out, advantage, after = np.empty(len(r)), np.zeros(len(edges) - 1), np.zeros(len(edges) - 1)
        for rows, at in places(edges, backward=True):
            counts = m[at] == 1
            fresh = r[at] + gamma * after[rows] - v[at] + gamma * lam * advantage[rows]
            advantage[rows] = out[at] = np.where(counts, fresh, advantage[rows])
            after[rows] = np.where(counts, v[at], after[rows])
        return _lists(out, edges, rewards, pa.float64())

    return fold


def counted_places(mask: pa.Array) -> pa.Array:
    (m,), edges = _together((mask,))
    total = np.r_[0, np.cumsum(m.astype(np.int64))]
    run = total[1:] - np.repeat(total[edges[:-1]], np.diff(edges))
    return _lists(np.maximum(run - 1, 0), edges, mask, pa.int32())


def means_before(start: float) -> Callable[[pa.Array], pa.Array]:
    def fold(rewards: pa.Array) -> pa.Array:
        (r,), edges = _together((rewards,))
        out, mean = np.empty(len(r)), np.full(len(edges) - 1, start)
        for t, (rows, at) in enumerate(places(edges, backward=False)):
            out[at] = mean[rows]
            mean[rows] = mean[rows] + (r[at] - mean[rows]) / (t + 1)
        return _lists(out, edges, rewards, pa.float64())

    return fold


def moving_averages(values: pa.Array, weight: pa.Array, start: pa.Array) -> pa.Array:
    """x = x * w + (1 - w) * v along each array, from a start value (null: the first value)."""
    (v,), edges = _together((values,))
    w = np.asarray(pc.fill_null(weight, 0.0))
    first = np.where(np.diff(edges) > 0, v[np.minimum(edges[:-1], max(len(v) - 1, 0))] if len(v) else 0.0, 0.0)
    run = np.where(np.asarray(pc.is_null(start)), first, np.asarray(pc.fill_null(start, 0.0)))
    out = np.empty(len(v))
    for rows, at in places(edges, backward=False):
        run[rows] = out[at] = run[rows] * w[rows] + (1 - w[rows]) * v[at]
    return _lists(out, edges, values, pa.float64())


def affine(factors: pa.Array, terms: pa.Array) -> pa.Array:
    """x = x * factor + term along each pair of arrays, from 0."""
    (f, t), edges = _together((factors, terms))
    out, run = np.empty(len(f)), np.zeros(len(edges) - 1)
    for rows, at in places(edges, backward=False):
        run[rows] = out[at] = run[rows] * f[at] + t[at]
    return _lists(out, edges, factors, pa.float64())


def over(fold: Callable[..., pa.Array], kind: str, *columns: str | Column) -> Column:
    """The fold as a column expression over one to three columns."""

    def one(a: pa.Array) -> pa.Array:
        return fold(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return fold(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return fold(a, b, c)

    return F.arrow_udf((one, two, three)[len(columns) - 1], kind)(*(F.col(c) if isinstance(c, str) else c for c in columns))
