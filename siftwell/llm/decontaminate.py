"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every run of ``width`` words of a benchmark item is a pattern (an item of fewer words is one
pattern).  Texts and items become the same plain form: lower-case words, one space before and
after each.  Patterns are kept in classes of similar length.  For a class whose shortest
pattern has m bytes, a shift table says for each block of bytes how far the search may move on
when the block ends an alignment of m bytes; at a shift of 0 the block's bucket names the
patterns that may stand there, and their bytes are compared.

The search moves many cursors at once: a text buffer is cut into lanes, and each step looks up
the blocks of all lanes that are still on their way.  Work is linear in the text and falls with
m; memory follows the batch and the pattern chunk.

Benchmarks are dealt by hash into chunks of about ``chunk_bytes``, so that what is broadcast
has a bound; with several chunks, documents are written once with a row number, scanned chunk by
chunk, and each document's findings are put together by that number.

Defined cases: null and empty texts have no words and are clean; null items and items without
words match nothing; an item_id that is null is reported as an empty string; repeated rows of
documents stay rows of their own; equal item_ids count once a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded_batches, materialise
from siftwell.llm.rolling import Batch, avalanche, cuts

#: Benchmark text of one pattern chunk (broadcast).
CHUNK_BYTES = 16 << 20
#: Text that is searched at once, and alignments of one lane.
SEARCH_BYTES, LANE = 4 << 20, 1024
NEWLINE, SPACE = 10, 32
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
FOUND = "n_words long, spans array<struct<start: long, length: long>>, items array<string>"

_PLAIN = np.full(256, SPACE, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _PLAIN[_low : _high + 1] = np.arange(_low, _high + 1)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


class Plain:
    """Texts as one buffer: a line each, a space on both sides of every word."""

    def __init__(self, texts: Batch, low: int, high: int):
        a, b = int(texts.offsets[low]), int(texts.offsets[high])
        body = _PLAIN[texts.buf[a:b]]
        n = high - low
        wide = np.full(b - a + 3 * n + 1, SPACE, np.uint8)
        at = texts.offsets[low : high + 1] - a + 3 * np.arange(n + 1)
        wide[at] = NEWLINE
        for i, s in enumerate(at[:-1].tolist()):
            x = s - 3 * i
            wide[s + 2 : at[i + 1] - 1] = body[x : x + int(at[i + 1]) - s - 3]
        blank = wide == SPACE
        stay = np.r_[True, ~(blank[1:] & blank[:-1])]
        self.size = int(stay.sum())
        self.buf = np.full(self.size + 8, NEWLINE, np.uint8)  # eight bytes can be read at any place
        self.buf[: self.size] = wide[stay]
        del wide, blank, stay, body
        head = self.buf[: self.size]
        self.lines = np.flatnonzero(head == NEWLINE)
        self.words = np.flatnonzero((head[1:] > SPACE) & (head[:-1] == SPACE)) + 1
        self.first = np.searchsorted(self.words, self.lines)  # of each line's words; one more at the end

    def block(self, places: np.ndarray, size: int) -> np.ndarray:
        """The bytes [place, place + size) as one number; at most eight."""
        out = np.zeros(len(places), np.uint64)
        for i in range(size):
            out |= self.buf[places + i].astype(np.uint64) << np.uint64(8 * i)
        return out


class _Class:
    """Patterns of similar length: windows [start, start + length) of the items' buffer."""

    def __init__(self, items: Plain, start: np.ndarray, length: np.ndarray, number: np.ndarray):
        self.m = m = int(length.min())
        self.b = b = min(m, 8, max(2, m // 3))
        depth = np.arange(m - b + 1)
        self.bits = int(min(24, max(12, 4 + int(len(start) * len(depth)).bit_length())))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        for j in depth[::-1].tolist():  # ever smaller shifts: a block that ends the alignment has 0
            reach = m - b - j
            h = self.hash(items.block(start + j, b))
            self.shift[h] = np.minimum(self.shift[h], reach)
        key = self.key(items, start)
        order = np.argsort(key, kind="stable")
        self.keys, self.start, self.length, self.number = key[order], start[order], length[order], number[order]

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        return (avalanche(blocks) >> np.uint64(64 - self.bits)).astype(np.int64)

    def key(self, text: Plain, places: np.ndarray) -> np.ndarray:
        """Names the bucket of an alignment: its last block and its first bytes."""
        return avalanche(text.block(places + self.m - self.b, self.b)) ^ text.block(places, min(self.m, 8))

    def candidates(self, text: Plain) -> np.ndarray:
        """Alignments at which the shift table stops."""
        most = text.size - self.m + 1
        if most <= 0:
            return np.zeros(0, np.int64)
        at = np.arange(0, most, LANE)
        end = np.minimum(at + LANE, most)
        found = []
        while len(at):
            step = self.shift[self.hash(text.block(at + self.m - self.b, self.b))]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def occurrences(self, text: Plain, items: Plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, length and pattern number of every occurrence."""
        at = self.candidates(text)
        key = self.key(text, at)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        many = high - low
        where = np.repeat(at, many)
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        ok = equal_spans(text, where, items, self.start[which], self.length[which])
        return where[ok], self.length[which[ok]], self.number[which[ok]]


def equal_spans(a: Plain, at: np.ndarray, b: Plain, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes are the same, span by span, eight bytes a step."""
    ok = at + length <= a.size
    live = np.flatnonzero(ok)
    done = 0
    while len(live):
        for i in range(done, done + 8):
            rest = live[length[live] > i]
            same = a.buf[at[rest] + i] == b.buf[start[rest] + i]
            ok[rest[~same]] = False
        done += 8
        live = live[ok[live] & (length[live] > done)]
    return ok


class Patterns:
    """The pattern classes of one chunk of items, and the items of every pattern."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        self.ids = ids
        self.items = items = Plain(Batch(pa.array(texts, pa.large_string())), 0, len(texts))
        words, first = items.words, np.r_[items.first, len(items.words)]
        many = np.diff(first)[: len(ids)]
        taken = np.minimum(many, width)
        windows = np.where(many > 0, many - taken + 1, 0)
        of = np.repeat(np.arange(len(ids)), windows)
        head = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + first[of]
        start = words[head] - 1 if len(head) else np.zeros(0, np.int64)
        tail = head + taken[of] - 1  # the last word; the space after it ends the pattern
        spaces = np.flatnonzero(items.buf[: items.size] == SPACE)
        stop = spaces[np.searchsorted(spaces, words[tail])] + 1 if len(tail) else np.zeros(0, np.int64)
        length = stop - start
        number, self.bounds, self.owners = self._distinct(start, length, of)
        some = np.unique(number, return_index=True)[1] if len(number) else np.zeros(0, np.int64)
        size = np.frexp(length[some].astype(float))[1] if len(some) else some
        self.classes = [_Class(items, start[some[size == s]], length[some[size == s]], number[some[size == s]]) for s in np.unique(size).tolist()]

    def _distinct(self, start: np.ndarray, length: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal windows under one number; for each number a range of owners."""
        seen: dict[bytes, int] = {}
        data = self.items.buf.tobytes()
        number = np.array([seen.setdefault(data[s : s + n], len(seen)) for s, n in zip(start.tolist(), length.tolist(), strict=True)], np.int64)
        order = np.lexsort((of, number))
        return number, np.searchsorted(number[order], np.arange(len(seen) + 1)), of[order]

    def search(self, text: Plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [c.occurrences(text, self.items) for c in self.classes]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def _findings(text: Plain, patterns: Patterns, n: int) -> tuple[list[list[dict]], list[list[str]]]:
    """Hit words as spans of each line, and the items whose windows occur in it."""
    at, length, number = patterns.search(text)
    spans: list[list[dict]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    if not len(at):
        return spans, items
    low, high = np.searchsorted(text.words, at + 1), np.searchsorted(text.words, at + length - 1)
    edge = np.zeros(len(text.words) + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    hit = np.cumsum(edge[:-1]) > 0
    first = np.r_[text.first, len(text.words)]
    lines = np.searchsorted(text.lines, at, side="right") - 1
    order = np.lexsort((number, lines))
    lines, number = lines[order], number[order]
    for i in np.unique(lines).tolist():
        own = hit[first[i] : first[i + 1]]
        turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
        spans[i] = [{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
        mine = np.unique(number[np.searchsorted(lines, i) : np.searchsorted(lines, i, side="right")])
        owners = np.unique(np.concatenate([patterns.owners[patterns.bounds[k] : patterns.bounds[k + 1]] for k in mine.tolist()]))
        items[i] = sorted({patterns.ids[o] for o in owners.tolist()})
    return spans, items


_READY: dict[str, Patterns] = {}


def _patterns(sent: Broadcast, width: int) -> Patterns:
    """The tables of a chunk, made once a worker; only the last chunk's are kept."""
    name, ids, texts = sent.value
    if (key := f"{name}-{width}") not in _READY:
        _READY.clear()
        _READY[key] = Patterns(ids, texts, width)
    return _READY[key]


def _scan(docs: DataFrame, kept: list[str], sent: Broadcast, width: int) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            patterns = _patterns(sent, width)
            size = np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0))
            for low, high in cuts(size, SEARCH_BYTES):
                part = whole.slice(low, high - low)
                text = Plain(Batch(part.column("text")), 0, part.num_rows)
                spans, items = _findings(text, patterns, part.num_rows)
                many = np.diff(np.r_[text.first, len(text.words)])[: part.num_rows]
                made = [pa.array(many, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], [*kept, "n_words", "spans", "items"])

    return docs.select(*kept, "text").mapInArrow(run, f"{schema}, {FOUND}")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, spans of words inside occurrences, and items (sorted ids) of every row of docs.

    docs: doc_id, text.  benchmark: item_id, text.  width: words of a window.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(chunks))

    def sent(i: int) -> Broadcast:
        got = items.where(part == i).toArrow() if chunks > 1 else items.toArrow()
        return spark.sparkContext.broadcast((uuid.uuid4().hex, got.column("id").to_pylist(), got.column("text").to_pylist()))

    if chunks == 1:
        return _scan(docs, ["doc_id"], sent(0), width)
    rows = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for i in range(chunks):  # one chunk's patterns are in memory at a time
        one = materialise(_scan(rows, ["row", "doc_id"], sent(i), width).where("size(items) > 0"), "found")
        found = one if found is None else found.unionByName(one)
    counts = _scan(rows, ["row", "doc_id"], spark.sparkContext.broadcast(("none", [], [])), width).select("row", "doc_id", "n_words")
    together = found.groupBy(F.col("row").alias("of")).agg(F.flatten(F.collect_list("spans")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<struct<start: long, length: long>>")
    return counts.join(together, F.col("row") == F.col("of"), "left").select(
        "doc_id", "n_words", F.coalesce(_merged(F.col("all")), none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def _merged(spans):
    """Spans that overlap or touch as one."""
    one = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("length"))
    end = lambda s: s.start + s.length

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one(last.start, F.greatest(end(last), end(s)) - last.start)))
        return F.when(F.size(done) == 0, F.array(s)).when(s.start <= end(last), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start: long, length: long>>"), add)
