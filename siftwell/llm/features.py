"""Hashed presence features of whole texts, computed batch-wise with NumPy.

Features are byte n-grams (any order up to 8) and words.  A feature counts once per document.
``unique_ids`` gives a document's feature ids, ``presence_sums`` adds a weight table over them;
both read every byte of every text and keep memory to one batch and one table of 2**bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import bounded_batches, discard, materialise
from siftwell.llm.rolling import Batch, avalanche, cuts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Hasher:
    """orders: byte n-gram lengths, 0 for whole words, -1 for the shape of six words in a row
    (which neighbours are equal); lower: fold A-Z before hashing."""

    def __init__(self, orders: tuple[int, ...], bits: int, lower: bool):
        self.orders, self.bits, self.lower = tuple(orders), bits, lower

    @property
    def size(self) -> int:
        return 1 << self.bits

    def per_document(self, batch: Batch) -> Iterator[list[np.ndarray]]:
        """For each document one id array per order, repeats included."""
        buf = _LOWER[batch.buf] if self.lower else batch.buf
        shift = np.uint64(64 - self.bits)
        ids, edges = [], []
        for n in self.orders:
            if n == 0:
                starts, ends, first = batch.words()
                ids.append((avalanche(batch.word_hashes(starts, ends, self.lower)) >> shift).astype(np.int32))
                edges.append((first[:-1], first[1:]))
            elif n < 0:
                starts, ends, first = batch.words()
                words = batch.word_hashes(starts, ends, self.lower)
                equal = (words[1:] == words[:-1]).astype(np.uint64)
                m = max(0, len(words) - 5)
                code = np.zeros(m, np.uint64)
                for i in range(5 if m else 0):
                    code |= equal[i : i + m] << np.uint64(i)
                ids.append((avalanche(code + np.uint64(0xA5A5)) >> shift).astype(np.int32))
                edges.append((np.minimum(first[:-1], m), np.maximum(np.minimum(first[1:] - 5, m), np.minimum(first[:-1], m))))
            else:
                code = np.zeros(max(0, len(buf) - n + 1), np.uint64)
                for i in range(n):
                    code |= buf[i : i + len(code)].astype(np.uint64) << np.uint64(8 * i)
                ids.append((avalanche(code + np.uint64(0x51ED27 * (n + 1))) >> shift).astype(np.int32))
                edges.append((batch.offsets[:-1], np.maximum(batch.offsets[1:] - n + 1, batch.offsets[:-1])))
        for d in range(len(batch.offsets) - 1):
            yield [x[a[d] : b[d]] for x, (a, b) in zip(ids, edges, strict=True)]

    def unique_ids(self, batch: Batch) -> Iterator[np.ndarray]:
        for parts in self.per_document(batch):
            yield np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)

    def presence_sums(self, batch: Batch, weights: np.ndarray) -> np.ndarray:
        """weights has shape (size, k); the result (documents, k)."""
        place, out = np.empty(self.size, np.int32), np.zeros((len(batch.offsets) - 1, weights.shape[1]))
        for d, parts in enumerate(self.per_document(batch)):
            ids = np.concatenate(parts)
            at = np.arange(len(ids), dtype=np.int32)
            place[ids] = at  # one of equal ids wins; that one counts
            out[d] = weights[ids[place[ids] == at]].sum(0)
        return out


def score_documents(docs: DataFrame, hasher: Hasher, weights: np.ndarray, finish, columns: list[str], schema: str, keep: list[str]) -> DataFrame:
    """keep columns plus columns computed by finish(sums); weights travel with the function."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            n = np.asarray(pc.fill_null(pc.binary_length(text), 0))
            for a, b in cuts(n, 1 << 18):
                part = batch.slice(a, b - a)
                values = finish(hasher.presence_sums(Batch(part.column("text")), weights))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(v) for v in values)], names=[*keep, *columns])

    return docs.mapInArrow(run, schema)


#: Bytes of feature ids that reach the driver; further rows of a sample are left out.
SAMPLE_BYTES = 256 << 20


def collect_sample(rows: DataFrame, hasher: Hasher, extra: list[str], most_bytes: int = SAMPLE_BYTES) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Feature ids and extra columns of a sample, one row a doc_id (which extra holds): at most most_bytes of ids.

    The number of rows is the caller's bound.  Rows are taken in order of a hash of doc_id; a row
    whose ids go beyond the bound, and those behind it, are left out.
    """
    fields = ", ".join(f"{c} long" for c in extra)
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
            for a, b in cuts(n, 1 << 18):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in hasher.unique_ids(Batch(part.column("text")))], pa.binary()), *(part.column(c) for c in extra)], names=["ids", *extra])

    made = materialise(rows.select("text", *(F.col(c).cast("long").alias(c) for c in extra)).mapInArrow(run, f"ids binary, {fields}"), "sample")
    one = made.groupBy("doc_id").agg(F.min(F.struct(*(c for c in extra if c != "doc_id"), "ids")).alias("s")).select("doc_id", "s.*")
    sizes = one.select("doc_id", F.sum(F.octet_length("ids")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("_sum"))  # as many rows as the caller's bound
    got = one.join(F.broadcast(sizes.where(F.col("_sum") <= most_bytes).select("doc_id")), "doc_id").select("ids", *extra).toArrow().combine_chunks()
    discard(made)
    values = {c: np.asarray(got.column(c)) for c in extra}
    order = np.lexsort(list(values.values())) if got.num_rows else np.zeros(0, np.int64)
    ids = []
    if got.num_rows:  # views into the one Arrow buffer (under 2 GB), no copies
        column = got.column("ids").chunk(0)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
        flat = np.frombuffer(column.buffers()[2], np.uint8)
        ids = [flat[offsets[i] : offsets[i + 1]].view(np.int32) for i in order.tolist()]
    return ids, {c: v[order] for c, v in values.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, allowed=None, columns: tuple[str, ...] = ("quality",), keep: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` labelled documents, those with the smallest hash of doc_id.

    The chosen label rows (at most ``most``) are broadcast, so documents are only scanned.
    """
    picked = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        picked = picked.where(F.col(c).isin(0, 1))
    if allowed is not None:
        picked = picked.where(allowed)
    picked = picked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(c).alias(c) for c in columns)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text", *keep).join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns, *keep)
