"""The distributed rounds of superwindow matching over a table of homes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import superwindows as S
from siftwell.llm.common import materialise
from siftwell.llm.homes import Home, homes_of

ENTRY, RUN, ASK = 0, 1, 2
#: Buckets are hashed to partitions; several to each even out.  A bucket takes the entries of at most about
#: BUCKET_BYTES of text (a third of that), so a larger corpus has more of them.
BUCKETS_PER_PARTITION, BUCKET_BYTES = 4, 64 << 20


def bucket_count(partitions: int, text_bytes: int) -> int:
    return max(BUCKETS_PER_PARTITION * partitions, -(-text_bytes // BUCKET_BYTES))


_ENTRIES = "kind int, bucket int, home int, payload binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("home", pa.int32()), ("payload", pa.binary())])
_ANSWERS = "home int, round int, bucket int, payload binary"
_ANSWER_SCHEMA = pa.schema([("home", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])

#: Gives a home's superwindows, and for some of them (by number) the contents as one blob each.
Finder = Callable[[Home], tuple[S.Found, Callable[[np.ndarray], list[bytes]]]]
#: Decides open contents of one bucket: (anchor, order, contents) to one bit mask each; bit i: window i repeats.
Decider = Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows with the same key, as they come sorted."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def entries(homes: DataFrame, finder: Finder, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home in homes_of(batch):
                found = finder(home)[0]
                anchor, check = found.anchor[found.heads], found.check[found.heads]
                edges = np.searchsorted(S.bucket_of(anchor, buckets), np.arange(buckets + 1))
                yield _batch([(ENTRY, b, home.home, S.pack_entries(anchor[edges[b] : edges[b + 1]], check[edges[b] : edges[b + 1]])) for b in range(buckets) if edges[b] < edges[b + 1]], _SCHEMA)

    return homes.mapInArrow(run, _ENTRIES)


def merge_entries(rows: DataFrame, partitions: int, keep_run: bool = True, verify: bool = False) -> DataFrame:
    """Bucket by bucket: codes for each home's entries, asks to index homes, and the new run.

    Output rows: kind ENTRY holds codes, ASK the (anchor, check) pairs that a home of the index
    must show, RUN the bucket's new distinct entries with their homes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _grouped(batches, "bucket"):
            parts, spans, at = [], [], 0
            for row in held:
                anchor, check, home = S.unpack_entries(row["payload"])
                parts.append((anchor, check, np.full(len(anchor), row["home"], np.int32) if home is None else home, np.full(len(anchor), row["kind"] == RUN)))
                spans.append((row["kind"], row["home"], at, at + len(anchor)))
                at += len(anchor)
            anchor, check, home, old = (np.concatenate(c) for c in zip(*parts, strict=True))
            code, ask, first = S.judge(anchor, check, home, old, verify)
            out = [(ENTRY, bucket, h, code[a:b].tobytes()) for kind, h, a, b in spans if kind == ENTRY]
            some = np.flatnonzero(ask)
            some = some[np.lexsort((check[some], anchor[some], home[some]))]
            for part in np.split(some, np.flatnonzero(np.diff(home[some])) + 1):
                if len(part):
                    out.append((ASK, bucket, int(home[part[0]]), S.pack_entries(anchor[part], check[part])))
            fresh = np.flatnonzero(~old & first)
            fresh = fresh[np.lexsort((check[fresh], anchor[fresh]))]
            if keep_run and len(fresh):
                out.append((RUN, bucket, -1, S.pack_entries(anchor[fresh], check[fresh], home[fresh])))
            yield _batch(out, _SCHEMA)

    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "home").mapInArrow(run, _ENTRIES)


def with_home(homes: DataFrame, answers: DataFrame, how: str = "left") -> DataFrame:
    """Each home row once, with all rows that are addressed to it; joined inner, only homes that something is addressed to."""
    own = answers.groupBy("home").agg(F.collect_list(F.struct("round", "bucket", "payload")).alias("answers"))
    return homes.join(own, "home", how)


def _codes(found: S.Found, answers: list[dict], buckets: int) -> np.ndarray:
    """The code of each head, put together from the buckets' answers."""
    code = np.zeros(len(found.heads), np.uint8)
    edges = np.searchsorted(S.bucket_of(found.anchor[found.heads], buckets), np.arange(buckets + 1))
    for x in answers:
        if x["round"] == ENTRY:
            code[edges[x["bucket"]] : edges[x["bucket"] + 1]] = np.frombuffer(x["payload"], np.uint8)
    return code


def _asked(found: S.Found, answers: list[dict]) -> np.ndarray:
    """Heads whose (anchor, check) an ask names."""
    pick = np.zeros(len(found.heads), bool)
    anchor, check = found.anchor[found.heads], found.check[found.heads]
    for x in answers:
        if x["round"] == ASK:
            a, c, _ = S.unpack_entries(x["payload"])
            low, high = np.searchsorted(anchor, a), np.searchsorted(anchor, a, side="right")
            for i, j, k in zip(low.tolist(), high.tolist(), c.tolist(), strict=True):
                pick[i:j] |= check[i:j] == k
    return np.flatnonzero(pick)


def open_contents(addressed: DataFrame, finder: Finder, buckets: int) -> DataFrame:
    """Contents of open heads (and of asked ones), by bucket: counts, anchors, places, blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for home, answers in zip(homes_of(batch), batch.column("answers").to_pylist(), strict=True):
                answers = answers or []
                if not answers:
                    continue
                found, content = finder(home)
                mine = np.flatnonzero(_codes(found, answers, buckets) == S.OPEN)
                rows = []
                for kind, heads in ((ENTRY, mine), (ASK, _asked(found, answers))):
                    edges = np.searchsorted(S.bucket_of(found.anchor[found.heads[heads]], buckets), np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(edges)).tolist():
                        which = found.heads[heads[edges[b] : edges[b + 1]]]
                        blobs = content(which)
                        packed = [np.array([len(which)], "<i8"), found.anchor[which], found.first[which].astype("<i8"), np.array([len(x) for x in blobs], "<i4")]
                        rows.append((kind, b, home.home, zstandard.ZstdCompressor(level=1).compress(b"".join([*(p.tobytes() for p in packed), *blobs]))))
                yield _batch(rows, _SCHEMA)

    return addressed.mapInArrow(run, _ENTRIES)


def decide_contents(contents: DataFrame, decide: Decider, partitions: int) -> DataFrame:
    """Per home and bucket the masks of its open heads, in the order in which they were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for bucket, held in _grouped(batches, "bucket"):
            anchors, orders, blobs, spans, at = [], [], [], [], 0
            for row in held:
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(row["payload"])
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                anchors.append(np.frombuffer(raw, np.uint64, n, 8))
                orders.append((np.int64(row["home"]) << np.int64(40)) + np.frombuffer(raw, "<i8", n, 8 + 8 * n))
                size = np.frombuffer(raw, "<i4", n, 8 + 16 * n)
                edge = 8 + 20 * n + np.r_[0, np.cumsum(size.astype(np.int64))]
                blobs += [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                spans.append((row["kind"], row["home"], at, at + n))
                at += n
            masks = decide(np.concatenate(anchors), np.concatenate(orders), blobs)
            yield _batch([(h, ASK + 1, bucket, masks[a:b].astype("<u8").tobytes()) for kind, h, a, b in spans if kind == ENTRY], _ANSWER_SCHEMA)

    return contents.repartition(partitions, "bucket").sortWithinPartitions("bucket", "home", "kind").mapInArrow(run, _ANSWERS)


def repeated(found: S.Found, answers: list[dict], buckets: int, size: int, equal: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each place of the home whether the window that starts there repeats an earlier one.

    equal compares the home's own copies with their heads; without it their hashes count.
    """
    code = _codes(found, answers, buckets)
    copies = found.copies if equal is None else found.copies[equal(found.copies, found.copied)]
    whole = np.concatenate([copies, found.heads[code == S.REPEAT]])
    edge = np.zeros(size + 1, np.int8)  # superwindows don't overlap
    edge[found.first[whole]] += 1
    edge[found.first[whole] + found.number[whole]] -= 1
    out = np.cumsum(edge[:-1], dtype=np.int8) > 0
    heads = np.flatnonzero(code == S.OPEN)
    edges = np.searchsorted(S.bucket_of(found.anchor[found.heads[heads]], buckets), np.arange(buckets + 1))
    for x in answers:
        if x["round"] == ASK + 1:
            which = found.heads[heads[edges[x["bucket"]] : edges[x["bucket"] + 1]]]
            masks = np.frombuffer(x["payload"], "<u8")
            for bit in range(int(masks.max(initial=0)).bit_length()):
                hit = which[(masks >> np.uint64(bit)) & np.uint64(1) == 1]
                out[found.first[hit] + bit] = True
    return out


#: Removed spans as a column.
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
NO_RUNS = np.zeros((0, 2), np.int64)


def removed_runs(mask: np.ndarray) -> np.ndarray:
    """Start and length of each stretch of a mask."""
    edge = np.diff(mask.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start = np.flatnonzero(edge == 1)
    return np.stack([start, np.flatnonzero(edge == -1) - start], 1)


def match(homes: DataFrame, finder: Finder, decide: Decider, buckets: int, partitions: int, runs: DataFrame | None = None, index_homes: DataFrame | None = None, keep_run: bool = True, verify: bool = False) -> tuple[DataFrame, DataFrame]:
    """Homes with all their answers, and the new run of the index.

    runs holds earlier runs of the index and index_homes the homes that they name; without
    keep_run no new run is made.  With verify every candidate's content is shipped and decided.
    """
    partitions = max(partitions, -(-buckets // BUCKETS_PER_PARTITION))
    rows = entries(homes, finder, buckets)
    if runs is not None:
        rows = rows.unionByName(runs.select("kind", "bucket", "home", "payload"))
    merged = materialise(merge_entries(rows, partitions, keep_run, verify), "merged")
    first = merged.where(F.col("kind") != RUN).select("home", F.col("kind").alias("round"), "bucket", "payload")
    asked = with_home(homes, first)
    if index_homes is not None:
        asked = asked.unionByName(with_home(index_homes, first.where(F.col("round") == ASK), "inner"))
    second = materialise(decide_contents(open_contents(asked, finder, buckets), decide, partitions), "decided")
    return with_home(homes, first.where(F.col("round") == ENTRY).unionByName(second)), merged.where(F.col("kind") == RUN)
