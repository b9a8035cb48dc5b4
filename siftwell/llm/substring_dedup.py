"""Substring deduplication on a log-structured fingerprint index.

The index holds immutable runs of window fingerprints (anchor hash, content check, home), each
sorted by fingerprint and cut into buckets.  A new batch of documents is cut into homes; its
sorted fingerprints are merge-joined with all runs bucket by bucket.  That chooses candidates only:
new and indexed homes show the contents of every anchor that occurs twice, and their words are
compared.  Then the batch's new fingerprints become a further run, and runs are compacted once
there are more than ``fan_in``.

A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document.  Words covered
by a window whose word sequence starts earlier (in an earlier batch, at a smaller doc_id, or
earlier in the document) are removed; windows are judged on the input.

Defined cases
    null or empty text: no words, hash of the empty string.  Documents shorter than a window keep
    all words.  Repeated rows with one doc_id: ordered by text; the second is removed as any copy.
    null doc_id: ordered after all others, returned as null.  Empty table: no rows.  Extra
    columns: ignored.  Very long texts are cut into chunks of window starts, which changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import superwindows as S
from siftwell.llm.common import remove, scratch, shuffle_partitions
from siftwell.llm.homes import MOST_HOMES, Home, home_table, homes_of
from siftwell.llm.window_match import BUCKETS_PER_PARTITION, NO_RUNS, RUN, RUNS, _grouped, bucket_count, match, removed_runs, repeated


def word_finder(window: int, gram: int):
    def finder(home: Home):
        batch = home.batch()
        starts, ends, edges = batch.words()
        values = batch.word_hashes(starts, ends)
        found = S.find(values, edges, window, gram)

        def content(which: np.ndarray) -> list[bytes]:
            """Per superwindow its first window's offset to the anchor (a byte pair) and its words, a space between two."""
            spans = zip((found.place[which] - found.first[which]).tolist(), starts[found.first[which]].tolist(), ends[found.first[which] + found.number[which] + window - 2].tolist(), strict=True)
            return [p.to_bytes(2, "little") + b" ".join(home.data[a:b].split()) for p, a, b in spans]

        return found, content

    return finder


def decide_windows(window: int):
    def decide(anchor: np.ndarray, order: np.ndarray, blobs: list[bytes]) -> np.ndarray:
        """Bit i of a mask: the i-th window's words occur under the same anchor and offset earlier."""
        mask = np.zeros(len(blobs), np.uint64)
        rank = np.lexsort((order, anchor)).tolist()
        keys = anchor[rank].tolist()
        whole: dict[bytes, int] = {}  # of the anchor: contents and their numbers of windows
        seen: set[tuple[int, bytes]] = set()  # and windows with their offsets, once contents differ
        for r, (i, key) in enumerate(zip(rank, keys, strict=True)):
            if not r or key != keys[r - 1]:
                whole, seen = {}, set()
            blob = blobs[i]
            if blob in whole:
                mask[i] = (1 << whole[blob]) - 1
                continue
            if len(whole) == 1:
                seen.update(_windows(next(iter(whole)), window))
            own = list(_windows(blob, window)) if whole else []
            mask[i] = sum(1 << k for k, w in enumerate(own) if w in seen)
            seen.update(own)
            whole[blob] = blob.count(b" ", 2) + 2 - window
        return mask

    return decide


def _windows(blob: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """The windows of a content, each with its offset to the anchor."""
    words, offset = blob[2:].split(b" "), int.from_bytes(blob[:2], "little")
    for k in range(len(words) - window + 1):
        yield offset - k, b" ".join(words[k : k + window])


def _same_words(home: Home, starts: np.ndarray, ends: np.ndarray, found: S.Found, window: int):
    """Whether superwindows of a home hold the same words as others of it."""

    def equal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        text = lambda w: zip(starts[found.first[w]].tolist(), ends[found.first[w] + found.number[w] + window - 2].tolist(), strict=True)
        return np.array([home.data[a:b].split() == home.data[c:d].split() for (a, b), (c, d) in zip(text(one), text(two), strict=True)], bool)

    return equal


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start: long, length: long>>"


def cut_words(addressed: DataFrame, window: int, gram: int, buckets: int, texts: bool, spans: bool = False) -> DataFrame:
    finder = word_finder(window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, answers in zip(homes_of(batch), batch.column("answers").to_pylist(), strict=True):
                found = finder(home)[0]
                starts, ends, edges = home.batch().words()
                hit = repeated(found, answers or [], buckets, int(edges[-1]), _same_words(home, starts, ends, found, window))
                edge = np.zeros(len(hit) + window + 1, np.int32)
                at = np.flatnonzero(hit)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[: len(hit)] > 0
                cols = [[], [], [], [], []]
                for d in range(len(home.doc_ids)):
                    words = home.data[home.offsets[d] : home.offsets[d + 1]].split()
                    mask = gone[edges[d] : edges[d + 1]]
                    n = int(mask.sum())
                    kept = b" ".join(compress(words, (~mask).tolist()) if n else words)
                    for c, v in zip(cols, (len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None, [{"start": x, "length": y} for x, y in (removed_runs(mask) if n else NO_RUNS).tolist()] if spans else None), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([home.ids(), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), RUNS), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"])

    return addressed.mapInArrow(run, _RESULT)


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints under a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 20, gram: int = 10, home_bytes: int = 4 << 20, buckets: int | None = None, fan_in: int = 4):
        if not 0 <= window - gram < 64:
            raise ValueError("window - gram must lie in 0..63")
        self.spark, self.path = spark, path or scratch(spark, "fingerprints")
        self.window, self.gram, self.home_bytes, self.fan_in = window, gram, home_bytes, fan_in
        self.partitions = shuffle_partitions(spark)
        self.buckets = buckets or bucket_count(self.partitions, 0)
        self.runs: list[str] = []
        self.tables: list[DataFrame] = []
        self.next_home = 0

    def add(self, docs: DataFrame, texts: bool = False, spans: bool = False, last: bool = False) -> DataFrame:
        """Deduplicate a batch against the index and within itself, then index it.

        With last the batch's own run isn't kept: nothing will be added after it.
        """
        homes, number = home_table(docs, self.home_bytes)
        homes = homes.withColumn("home", (F.col("home") + self.next_home).cast("int"))
        self.next_home += number
        old = self.spark.read.schema("kind int, bucket int, home int, payload binary").parquet(*self.runs) if self.runs else None
        before = None
        for t in self.tables:
            before = t if before is None else before.unionByName(t)
        addressed, run = match(homes, word_finder(self.window, self.gram), decide_windows(self.window), self.buckets, self.partitions, old, before, keep_run=not last, verify=True)
        if not last:
            self.tables.append(homes)
            self._keep(run)
        return cut_words(addressed, self.window, self.gram, self.buckets, texts, spans)

    def _keep(self, run: DataFrame) -> None:
        path = f"{self.path}/run-{len(self.runs)}-{self.next_home}"
        run.write.parquet(path)
        self.runs.append(path)
        if len(self.runs) > self.fan_in:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket; old runs are deleted after the new is there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, held in _grouped(batches, "bucket"):
                parts = [S.unpack_entries(r["payload"]) for r in held]
                anchor, check, home = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = S.merged_order(anchor, check, home)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((RUN, bucket, -1, S.pack_entries(anchor[order], check[order], home[order])), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "bucket", "home", "payload"])

        schema = "kind int, bucket int, home int, payload binary"
        rows = self.spark.read.schema(schema).parquet(*self.runs)
        path = f"{self.path}/compacted-{self.next_home}"
        rows.repartition(max(self.partitions, -(-self.buckets // BUCKETS_PER_PARTITION)), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema).write.parquet(path)
        for old in self.runs:
            remove(self.spark, old)
        self.runs = [path]

    def describe(self) -> str:
        return json.dumps({"runs": len(self.runs), "homes": self.next_home, "buckets": self.buckets})


def dedup_substrings(docs: DataFrame, batches: int = 2, window: int = 20, gram: int = 10, home_bytes: int = 4 << 20, texts: bool = False, spans: bool = False, fan_in: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with texts also kept_text, with spans
    also the removed word spans.

    The table goes through the index in batches of ascending doc_id; a table of more than
    MOST_HOMES * home_bytes bytes takes as many batches as that needs.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    batches = max(batches, -(-size // (MOST_HOMES * home_bytes)))
    cut = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(c) for c in cut})
    index = FingerprintIndex(docs.sparkSession, window=window, gram=gram, home_bytes=home_bytes, fan_in=fan_in, buckets=bucket_count(shuffle_partitions(docs.sparkSession), size))
    out = None
    key = F.col("doc_id").cast("long")
    for i in range(len(edges) + 1):
        low = key > edges[i - 1] if i else F.lit(True)
        part = docs.where(key.isNull() | low) if i == len(edges) else docs.where(low & (key <= edges[i]))
        done = index.add(part, texts, spans, last=i == len(edges))
        out = done if out is None else out.unionByName(done)
    return out.drop(*([] if texts else ["kept_text"]), *([] if spans else ["removed"]))
