"""Homes: contiguous doc_id ranges of a corpus, one compressed row each.

Window matching needs the order of documents and several passes over texts.  Homes give both:
home numbers ascend with doc_id, a home's documents lie in one row (ids, lengths, zstd text of
about ``home_bytes``), and every later pass reads that table without a shuffle of its own.

Rows with a null doc_id come last, in homes of their own by a hash of their text; rows with equal doc_id
stay together, ordered by text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded_batches, materialise
from siftwell.llm.rolling import Batch, cuts

NULL_ID = np.int64(2**63 - 1)
#: Range bounds held by the driver; a corpus beyond MOST_HOMES * home_bytes gets larger homes.
MOST_HOMES = 1 << 20
SCHEMA = "home int, doc_ids binary, lengths binary, body binary"
ARROW = pa.schema([("home", pa.int32()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("body", pa.binary())])


def pack_home(home: int, doc_ids: np.ndarray, texts: list[bytes]) -> tuple:
    import zstandard

    return home, doc_ids.astype("<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


class Home:
    """A home's documents: ids, byte offsets, and the bytes."""

    def __init__(self, home: int, doc_ids: bytes, lengths: bytes, body: bytes):
        import zstandard

        self.home, self.doc_ids = home, np.frombuffer(doc_ids, "<i8")
        self.offsets = np.r_[0, np.cumsum(np.frombuffer(lengths, "<i8"))].astype(np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(int(self.offsets[-1]), 1))

    def ids(self) -> pa.Array:
        return pa.array(self.doc_ids, mask=self.doc_ids == NULL_ID)

    def batch(self) -> Batch:
        out = Batch.__new__(Batch)
        out.buf, out.offsets = np.frombuffer(self.data, np.uint8), self.offsets
        return out


def homes_of(batch: pa.RecordBatch) -> Iterator[Home]:
    for i in range(batch.num_rows):
        yield Home(*(batch.column(c)[i].as_py() for c in ("home", "doc_ids", "lengths", "body")))


def home_table(docs: DataFrame, home_bytes: int) -> tuple[DataFrame, int]:
    """The written table of homes and their number."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("doc_id"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text"))), F.count(F.lit(1))).first()
    number = int(min(MOST_HOMES, max(1, -(-(size[0] or 0) // home_bytes)), max(1, size[1])))
    cut = rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / number for i in range(1, number)], max(1 / (8 * number), 1e-6)) if number > 1 else []
    bounds = np.unique(np.array(cut, np.float64).astype(np.int64))
    nameless = -(-(size[2] or 0) // home_bytes) or int(size[3] > size[1])  # homes of rows without doc_id

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0))
            for low, high in cuts(size, 8 << 20):
                batch = whole.slice(low, high - low)
                ids = np.asarray(batch.column("doc_id").fill_null(NULL_ID))
                texts = Batch(batch.column("text"))
                home = np.searchsorted(bounds, ids, side="right")
                for i in np.flatnonzero(np.asarray(batch.column("doc_id").is_null())).tolist():
                    home[i] = len(bounds) + 1 + zlib.crc32(texts.buf[texts.offsets[i] : texts.offsets[i + 1]]) % nameless
                order = np.argsort(home, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(home[order]) != 0, True]) if len(order) else [0]
                data = texts.buf.tobytes()
                made = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    some = order[a:b]
                    made.append(pack_home(int(home[some[0]]), ids[some], [data[texts.offsets[i] : texts.offsets[i + 1]] for i in some]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), ARROW, strict=True)] if made else [pa.array([], f.type) for f in ARROW], schema=ARROW)

    def merge(group: pa.Table) -> pa.Table:
        ids, texts = [], []
        for i in range(group.num_rows):
            h = Home(*(group.column(c)[i].as_py() for c in ARROW.names))
            ids.append(h.doc_ids)
            texts += [h.data[h.offsets[j] : h.offsets[j + 1]] for j in range(len(h.doc_ids))]
        ids = np.concatenate(ids)
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        row = pack_home(group.column("home")[0].as_py(), ids[order], [texts[i] for i in order])
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, ARROW, strict=True)], schema=ARROW)

    packed = rows.mapInArrow(spread, SCHEMA).groupBy("home").applyInArrow(merge, SCHEMA)
    return materialise(packed, "homes"), len(bounds) + 1 + nameless
