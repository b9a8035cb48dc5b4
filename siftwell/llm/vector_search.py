"""Exact top-k inner products with multi-resolution segment statistics.

With a vector cut into segments, |q - x|^2 >= sum over segments of len * ((mean_q - mean_x)^2 +
(std_q - std_x)^2).  As q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, the same statistics bound the inner
product from above: q.x <= sum len * (mean_q * mean_x + std_q * std_x).  Bounds are taken coarse
to fine (1, 4, 16, ... segments, last seven eighths as many as there are components); a pair that
cannot reach its query's k-th score so far is dropped, and exact integer products are computed for
the pairs that survive, pair by pair.

Every query starts with a floor: the k-th score that a bounded sample of rows already gives it.
Queries and candidates are cut into blocks; each task takes one block of each, so its memory has
a fixed bound at every input size, and returns at most k rows per query.

Defined cases
    Vectors that are null, empty, or hold null or non-finite components take no part.  Vectors of
    different length never meet.  null vec_id: takes no part (a result could not name it).
    Repeated rows: candidates of their own; a query never meets a row with its own id.  A vec_id
    repeated among queries: one result set, for the first of the rows in component order.
    Scores are exact integers; one beyond the range of a long counts as that range's end.
    Components are whole numbers below 2**63.  Empty table: no rows.  Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that give every query its first floor; at most SAMPLE_BYTES of them reach the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 16 << 20
#: Surviving pairs whose products are computed at once.
PAIRS = 1 << 16
_LEAST = np.iinfo(np.int64).min


def levels(dim: int) -> list[int]:
    """Numbers of segments: powers of 4 up to half the components, then half, three and seven eighths of them."""
    out, n = [], 1
    while n < dim // 2:
        out.append(n)
        n *= 4
    return sorted({*out, *(max(1, dim * part // 8) for part in (4, 6, 7))})


def statistics(x: np.ndarray, level: int) -> np.ndarray:
    """Per segment sqrt(len) * mean and sqrt(len) * std, side by side."""
    edges = np.linspace(0, x.shape[1], min(level, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.concatenate([total / np.sqrt(size), np.sqrt(np.maximum(square - total * total / size, 0))], axis=1)


def products(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (qi, xi): in doubles while they hold every partial sum, else in integers."""
    out = np.empty(len(qi), np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    for a in range(0, len(qi), PAIRS):
        left, right = q[qi[a : a + PAIRS]], x[xi[a : a + PAIRS]]
        if most < 2**53:
            out[a : a + PAIRS] = np.einsum("ij,ij->i", left, right)
        elif most < 2**62:
            out[a : a + PAIRS] = np.einsum("ij,ij->i", left.astype(np.int64), right.astype(np.int64))
        else:
            whole = [sum(int(u) * int(v) for u, v in zip(s, t, strict=True)) for s, t in zip(left.tolist(), right.tolist(), strict=True)]
            out[a : a + PAIRS] = [max(_LEAST, min(v, -_LEAST - 1)) for v in whole]
    return out


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, step: int = 2048, floors: np.ndarray | None = None, seen: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the exact k best of x by (score descending, id ascending), own id left out.

    floors: scores that are not worth less than a query's k-th one.  seen collects the numbers of
    pairs after each level of bounds.
    """
    fine = levels(q.shape[1])
    qs, xs = [statistics(q, n) for n in fine], [statistics(x, n) for n in fine]
    q_norm, x_norm = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", x, x))
    slack = 1e-9 * (1 + q_norm * x_norm.max(initial=0))  # rounding of the bounds
    order = np.argsort(-x_norm, kind="stable")  # the largest norms first: the k-th score rises early
    floor = np.full(len(q), -np.inf) if floors is None else floors.astype(np.float64).copy()
    own, score, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(order), step):
        rows = order[a : a + step]
        alive = q_ids[:, None] != x_ids[rows][None, :]
        count = [int(alive.sum())]
        for lq, lx in zip(qs, xs, strict=True):
            some_q, some_x = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if len(some_q):
                bound = lq[some_q] @ lx[rows[some_x]].T
                alive[np.ix_(some_q, some_x)] &= bound + slack[some_q, None] >= floor[some_q, None]
            count.append(int(alive.sum()))
        if seen is not None:
            seen[:] = [x + y for x, y in zip(seen or [0] * len(count), count, strict=True)]
        qi, xi = np.nonzero(alive)
        if not len(qi):
            continue
        value = products(q, x, qi, rows[xi])
        good = value >= floor[qi]
        own, score, found = np.r_[own, qi[good]], np.r_[score, value[good]], np.r_[found, x_ids[rows[xi[good]]]]
        rank = np.lexsort((found, -score.astype(np.float64) if len(score) and score.min() == _LEAST else -score, own))
        own, score, found = own[rank], score[rank], found[rank]
        first = np.searchsorted(own, np.arange(len(q) + 1))
        place = np.arange(len(own)) - first[own]
        full = np.flatnonzero(np.diff(first) >= k)
        floor[full] = np.maximum(floor[full], score[first[full] + k - 1])
        own, score, found = own[place < k], score[place < k], found[place < k]
    first = np.searchsorted(own, np.arange(len(q) + 1))
    for i in range(len(q)):
        yield i, score[first[i] : first[i + 1]], found[first[i] : first[i + 1]]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def with_floors(q: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """q with the k-th score among the sampled rows of its length (null if they are fewer than k)."""
    widest = x.agg(F.max("dim")).first()[0] or 1
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * widest)))
    got = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("vec_id", "v", "dim").toArrow()
    sample = {}
    for dim in set(got.column("dim").to_pylist()):
        part = got.filter(pc.equal(got.column("dim"), dim))
        sample[dim] = (np.asarray(part.column("vec_id")), _matrix(part.column("v"), dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids = np.asarray(batch.column("dim")), np.asarray(batch.column("vec_id"))
            out = np.full(batch.num_rows, _LEAST)
            for dim in np.unique(dims).tolist():
                if dim not in sample:
                    continue
                rows = np.flatnonzero(dims == dim)
                vectors = _matrix(batch.column("v").take(pa.array(rows)), dim)
                for a in range(0, len(rows), 512):
                    for i, scores, _ in search_block(vectors[a : a + 512], ids[rows[a : a + 512]], sample[dim][1], sample[dim][0], k):
                        if len(scores) == k:
                            out[rows[a + i]] = scores[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "floor"])

    return q.mapInArrow(run, "vec_id long, v array<double>, dim int, floor long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 8192, id_col: str = "vec_id", vec_col: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score for integer-valued vectors given as array<double>.

    The number of blocks follows from one count each, so a task's two blocks hold about
    ``block`` rows at any size.
    """
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.size(vec_col).alias("dim"))
    q = queries.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.size(vec_col).alias("dim"))
    q = q.groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("s")).select("vec_id", "s.v", "s.dim")
    nq, nx = q.count(), x.count()
    bq, bx = max(1, -(-nq // block)), max(1, -(-nx // block))
    left = with_floors(q, x, k).withColumn("bq", F.pmod(F.xxhash64("vec_id"), F.lit(bq)).cast("int")).withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(bx - 1))))
    # rows are dealt with another seed, or many that share an id would always meet the same queries
    right = x.withColumn("bx", F.pmod(F.xxhash64(F.lit("row"), "vec_id", "v"), F.lit(bx)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if a.num_rows and b.num_rows:
            dim = a.column("dim")[0].as_py()
            ids, xs = np.asarray(b.column("vec_id")), _matrix(b.column("v"), dim)
            q_ids, qs, floors = np.asarray(a.column("vec_id")), _matrix(a.column("v"), dim), np.asarray(a.column("floor"))
            for at in range(0, len(qs), 512):
                for i, scores, found in search_block(qs[at : at + 512], q_ids[at : at + 512], xs, ids, k, floors=floors[at : at + 512]):
                    out[0].append(np.full(len(found), q_ids[at + i]))
                    out[1].append(found)
                    out[2].append(scores)
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2]})

    keys = ["bq", "bx", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
