"""Byte-exact deduplication of repeated substrings with suffix arrays built by linear grouping.

Candidates come from superwindows (see superwindows.py); hashes choose them, bytes decide.  Contents
that share an anchor are brought together: one that equals an older one repeats whole, and the
different ones are compared by a suffix array: contents stand aligned at the anchor, their columns are
cut wherever any two of them part, and each piece becomes one symbol.  The symbol strings of a
whole bucket are sorted as one text by lyndon_sort; the longest common prefix (in bytes) of a
suffix with any earlier content's suffix tells which of its windows repeat an earlier one.

Texts are UTF-8 bytes; every byte covered by a ``length``-byte string that also starts earlier
(smaller doc_id, or earlier in the document) is removed.  Strings never cross documents, may
overlap, and are judged on the input.

Defined cases
    null text: empty.  Documents shorter than ``length``: nothing is removed.  Repeated rows with
    one doc_id: ordered by text; the second is removed as any copy.  null doc_id: ordered after
    all others, returned as null.  Empty table: no rows.  Extra columns: ignored by the query,
    kept by deduplicated_documents.  Cuts may split a character: byte counts and digests follow the
    bytes, kept texts keep such a character whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm import superwindows as S
from siftwell.llm.common import carried, restored, shuffle_partitions
from siftwell.llm.homes import Home, home_table, homes_of
from siftwell.llm.lyndon_sort import common_prefixes, suffix_array
from siftwell.llm.rolling import avalanche, byte_values
from siftwell.llm.window_match import NO_RUNS, RUNS, bucket_count, match, removed_runs, repeated


def byte_finder(length: int, gram: int):
    def finder(home: Home):
        batch = home.batch()
        found = S.Found([])
        parts, at = [], 0
        edges = home.offsets
        # values of about a MB at a time; document edges are kept
        for a, b in _stretches(edges, 1 << 20):
            piece = S.find(byte_values(batch.buf[edges[a] : edges[b]]), edges[a : b + 1] - edges[a], length, gram)
            parts.append((piece.anchor, piece.check, piece.place + edges[a], piece.first + edges[a], piece.number))
            at = b
        found = S.Found(parts) if at else found

        def content(which: np.ndarray) -> list[bytes]:
            """Per superwindow its anchor's offset (one byte pair) and its bytes."""
            data = home.data
            return [int(p - f).to_bytes(2, "little") + data[f : f + n + length - 1] for f, n, p in zip(found.first[which].tolist(), found.number[which].tolist(), found.place[which].tolist(), strict=True)]

        return found, content

    return finder


def _stretches(edges: np.ndarray, most: int) -> list[tuple[int, int]]:
    out, a = [], 0
    while a < len(edges) - 1:
        b = int(np.searchsorted(edges, edges[a] + most, side="right")) - 1
        b = max(a + 1, min(b, len(edges) - 1))
        out.append((a, b))
        a = b
    return out


def _side(group: np.ndarray, cells: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of one side's contexts (row per content, near cells first, 0 past its end): per group the places where two part.

    cells has one more column than the longest context, so an end parts from whatever goes on.
    """
    n, width = cells.shape
    parted = np.zeros((int(group[-1]) + 1 if n else 0, width), bool)
    parted[group, length] = True
    packed = np.zeros((n, -(-width // 4) * 4), np.uint16)
    packed[:, :width] = cells
    keys = packed.astype(">u2").view(">u8").astype(np.uint64)
    order = np.lexsort([*(keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)), group])
    if n > 1:
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        a, b = a[same], b[same]
        differ = cells[a] != cells[b]
        any_ = differ.any(1)
        parted[group[a[any_]], differ[any_].argmax(1)] = True
    return parted


def decide_bytes(length: int, gram: int, most: int = 10_000):
    """Contents that equal an older one byte by byte repeat whole; the different ones of an anchor meet in a suffix array."""

    def decide(anchor: np.ndarray, order: np.ndarray, blobs: list[bytes]) -> np.ndarray:
        mask = np.zeros(len(blobs), np.uint64)
        rank = np.lexsort((order, anchor)).tolist()
        keys = anchor[rank].tolist()
        groups: list[list[int]] = []  # per anchor its different contents, oldest first
        seen: set[bytes] = set()
        for r, (i, key) in enumerate(zip(rank, keys, strict=True)):
            if not r or key != keys[r - 1]:
                groups.append([])
                seen = set()
            blob = blobs[i]
            if blob in seen:
                mask[i] = (1 << (len(blob) - 2 - length + 1)) - 1
            else:
                seen.add(blob)
                groups[-1].append(i)
        rows: list[int] = []
        group: list[int] = []
        for g in (g for g in groups if len(g) > 1):  # whole groups, some ten thousand contents at a time
            group += [group[-1] + 1 if group else 0] * len(g)
            rows += g
            if len(rows) >= most:
                mask[rows] = _decide_groups(np.array(group), [blobs[i] for i in rows], length, gram)
                rows, group = [], []
        if rows:
            mask[rows] = _decide_groups(np.array(group), [blobs[i] for i in rows], length, gram)
        return mask

    return decide


def _decide_groups(group: np.ndarray, blobs: list[bytes], length: int, gram: int) -> np.ndarray:
    """Masks of contents that are sorted by group and, inside, by age (oldest first)."""
    n, wide = len(blobs), length - gram
    size = np.array([len(b) - 2 for b in blobs])
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    head = np.r_[0, np.cumsum(size + 2)][:-1]
    left = raw[head].astype(np.int64) + 256 * raw[head + 1].astype(np.int64)
    number = size - length + 1
    right = size - left - gram
    body = head + 2

    def cells(towards: int, near: np.ndarray, have: np.ndarray) -> np.ndarray:
        col = np.arange(wide + 1)
        where = near[:, None] + towards * col[None, :]
        ok = col[None, :] < have[:, None]
        return np.where(ok, raw[np.clip(where, 0, len(raw) - 1)].astype(np.uint16) + 1, 0)

    lcells, rcells = cells(-1, body + left - 1, left), cells(1, body + left + gram, right)
    # the anchors themselves are compared too: contents whose anchor bytes differ are other groups
    anchors = raw[(body + left)[:, None] + np.arange(gram)[None, :]]
    same = np.r_[True, (anchors[1:] == anchors[:-1]).all(1)] if n else np.zeros(0, bool)
    fresh = np.r_[True, group[1:] != group[:-1]] | ~same if n else same
    group = np.cumsum(fresh) - 1
    lparted, rparted = _side(group, lcells, left), _side(group, rcells, right)

    def hashes(c: np.ndarray) -> np.ndarray:
        """Running hash per row of the cells so far."""
        out = np.zeros((len(c), c.shape[1] + 1), np.uint64)
        for i in range(c.shape[1]):
            out[:, i + 1] = avalanche(out[:, i] * np.uint64(0x9E3779B97F4A7C15) + c[:, i].astype(np.uint64) + np.uint64(1))
        return out

    # pieces: left ones from far to near, the anchor, right ones from near to far
    lrun, rrun = hashes(lcells), hashes(rcells)
    content, kind, key, width, start, reach_of = [], [], [], [], [], []
    owner = np.arange(n)
    for side, parted, have, running in ((0, lparted, left, lrun), (2, rparted, right, rrun)):
        cut = parted[group]  # row per content: place p is an edge if contexts part there
        cut[:, 0] = True
        rows, at = np.nonzero(cut & (np.arange(wide + 1)[None, :] < have[:, None]))
        nxt = np.full((n, wide + 2), 0)
        edge = np.where(cut, np.arange(wide + 1)[None, :], wide + 2)
        upcoming = np.minimum.accumulate(edge[:, ::-1], axis=1)[:, ::-1]  # the first edge at or after
        nxt[:, : wide + 1] = upcoming
        end = np.minimum(nxt[rows, at + 1], have[rows])
        content.append(rows)
        kind.append(np.full(len(rows), side))
        # up to a piece's far end the contexts agree or not: the running hash there proposes equal ones
        key.append(np.stack([at, running[rows, end].astype(np.int64)], 1))
        width.append(end - at)
        reach_of.append(end)
        start.append(left[rows] - end if side == 0 else left[rows] + gram + at)
    content.append(owner)
    kind.append(np.full(n, 1))
    key.append(np.zeros((n, 2), np.int64))
    width.append(np.full(n, gram))
    reach_of.append(np.zeros(n, np.int64))
    start.append(left)
    content, kind, width, start, key, reach_of = (np.concatenate(x) for x in (content, kind, width, start, key, reach_of))
    place = np.lexsort((start, content))
    content, kind, width, start, key, reach_of = content[place], kind[place], width[place], start[place], key[place], reach_of[place]
    # symbols: one per piece of one group, side and place; hashes bring equal pieces together, bytes decide
    by = np.lexsort((key[:, 1], key[:, 0], kind, group[content]))
    g, k0, k1, kk = group[content][by], key[by, 0], key[by, 1], kind[by]
    step = np.r_[True, (g[1:] != g[:-1]) | (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]) | (kk[1:] != kk[:-1])] if len(by) else np.zeros(0, bool)
    for side, table in ((0, lcells), (2, rcells)):
        for a in range(0, len(by) - 1, 1 << 16):
            one, two = by[a : a + (1 << 16)], by[a + 1 : a + (1 << 16) + 1]
            one = one[: len(two)]
            ours = (kind[two] == side) & ~step[a + 1 : a + 1 + len(two)]
            one, two = one[ours], two[ours]
            differ = ((table[content[one]] != table[content[two]]) & (np.arange(wide + 1)[None, :] < reach_of[two][:, None])).any(1)
            step[a + 1 + np.flatnonzero(ours)[differ]] = True
    symbol = np.empty(len(by), np.int64)
    symbol[by] = np.cumsum(step) + 1
    # one text: each content's symbols and a 1 behind; a 0 ends it all
    spot = np.arange(len(content)) + content
    text = np.ones(len(content) + n + 1, np.int64)
    text[spot] = symbol
    text[-1] = 0
    order = suffix_array(text)
    listed = text.tolist()
    lcp = common_prefixes(listed, order, 1)
    weight = np.zeros(len(text) + 1, np.int64)
    weight[spot + 1] = width
    weight = np.cumsum(weight)
    order = np.array(order)
    bytes_common = weight[np.minimum(order + np.array(lcp), len(text))] - weight[order]
    age = np.full(len(text), n, np.int64)
    age[spot] = content
    longest = _longest_with_older(order, np.array(lcp), bytes_common, age)
    reach = longest[spot]
    # windows of piece [start, start + width) up to the anchor's start that the common bytes cover
    hit = (reach >= length) & (kind <= 1)
    low = start[hit]
    high = np.minimum(np.minimum(start[hit] + np.where(kind[hit] == 1, 1, width[hit]) - 1, start[hit] + reach[hit] - length), number[content[hit]] - 1)
    mask = np.zeros(n, np.uint64)
    ok = high >= low
    ones = (np.uint64(1) << (high[ok] - low[ok] + 1).astype(np.uint64)) - np.uint64(1)
    np.bitwise_or.at(mask, content[hit][ok], ones << low[ok].astype(np.uint64))
    return mask


def _longest_with_older(order: np.ndarray, lcp: np.ndarray, common: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Per text place the most bytes that its suffix shares with a suffix of an older content.

    In each run of suffixes with a common first symbol that is the nearest older one on either
    side; one pass per side keeps a stack of ever older suffixes with the least common prefix.
    """
    n = len(order)
    best = [0] * n
    ages, commons, live = age[order].tolist(), common.tolist(), (lcp > 0).tolist()
    order_list = order.tolist()
    stack: list[tuple[int, int]] = []  # (age, bytes shared with the suffix above it on the stack)
    for r in range(n):
        if not live[r]:
            stack.clear()
            stack.append((ages[r], 0))
            continue
        least = commons[r]
        while stack and stack[-1][0] >= ages[r]:
            _, c = stack.pop()
            if stack and c < least:
                least = c
        if stack:
            best[order_list[r]] = least
        stack.append((ages[r], least))
    stack.clear()
    for r in range(n - 1, -1, -1):
        if r + 1 >= n or not live[r + 1]:
            stack.clear()
            stack.append((ages[r], 0))
            continue
        least = commons[r + 1]
        while stack and stack[-1][0] >= ages[r]:
            _, c = stack.pop()
            if stack and c < least:
                least = c
        if stack and least > best[order_list[r]]:
            best[order_list[r]] = least
        stack.append((ages[r], least))
    return np.array(best)


def _same_bytes(data: bytes, found: S.Found, length: int):
    """Whether superwindows of a home hold the same bytes as others of it."""

    def equal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        spans = zip(found.first[one].tolist(), found.first[two].tolist(), (found.number[one] + length - 1).tolist(), strict=True)
        return np.array([data[a : a + n] == data[b : b + n] for a, b, n in spans], bool)

    return equal


def _whole_characters(buf: np.ndarray, gone: np.ndarray) -> str:
    """The kept text: a character goes if all its bytes go, so cuts never split one."""
    if not gone.any():
        return buf.tobytes().decode()
    first = np.flatnonzero((buf & 0xC0) != 0x80)
    whole = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.r_[first, len(buf)]))
    return buf[~whole].tobytes().decode()


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, removed array<struct<start: long, length: long>>, ord int"


def cut_bytes(addressed: DataFrame, length: int, gram: int, buckets: int, texts: bool, spans: bool = False) -> DataFrame:
    finder = byte_finder(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, answers in zip(homes_of(batch), batch.column("answers").to_pylist(), strict=True):
                found = finder(home)[0]
                hit = repeated(found, answers or [], buckets, len(home.data), _same_bytes(home.data, found, length))
                edge = np.zeros(len(hit) + length + 1, np.int32)  # as many stretches as a window is long may overlap
                edge[: len(hit)] += np.diff(hit.astype(np.int8), prepend=np.int8(0)) == 1  # a stretch of windows starts
                fall = np.flatnonzero(np.r_[hit[:-1] & ~hit[1:], hit[-1:]]) if len(hit) else np.zeros(0, int)
                edge[fall + length] -= 1
                gone = np.cumsum(edge)[: len(hit)] > 0
                buf = np.frombuffer(home.data, np.uint8)
                cols = [[], [], [], [], [], []]
                for a, b in zip(home.offsets[:-1].tolist(), home.offsets[1:].tolist(), strict=True):
                    mask = gone[a:b]
                    n = int(mask.sum())
                    runs = removed_runs(mask) if n else NO_RUNS
                    n_spans = len(runs)
                    kept = buf[a:b][~mask].tobytes() if n else home.data[a:b]
                    for c, v in zip(cols, (b - a, n, n_spans, hashlib.sha256(kept).hexdigest(), _whole_characters(buf[a:b], mask) if texts else None, [{"start": x, "length": y} for x, y in runs.tolist()] if spans else None), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), RUNS)
                ids = home.doc_ids  # ascending; rows of one id are numbered from 1
                number = np.arange(len(ids)) - np.searchsorted(ids, ids) + 1
                yield pa.RecordBatch.from_arrays([home.ids(), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(number, pa.int32())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "removed", "ord"])

    return addressed.mapInArrow(run, _RESULT)


def dedup_suffixes(docs: DataFrame, length: int = 100, gram: int | None = None, home_bytes: int = 4 << 20, texts: bool = False, spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with texts also kept_text and ord (a
    row's number among those of its doc_id), with spans the removed byte spans.

    gram is the anchor's length; length - gram must stay under 64 (one bit per window).
    """
    gram = gram or max(length - 36, -(-length // 2))
    if not 0 <= length - gram < 64:
        raise ValueError("length - gram must lie in 0..63")
    homes, number = home_table(docs, home_bytes)
    partitions = shuffle_partitions(docs.sparkSession)
    buckets = bucket_count(partitions, number * home_bytes)
    addressed, _ = match(homes, byte_finder(length, gram), decide_bytes(length, gram), buckets, partitions, keep_run=False, verify=True)
    out = cut_bytes(addressed, length, gram, buckets, texts, spans)
    return out.drop(*([] if texts else ["kept_text", "ord"]), *([] if spans else ["removed"]))


def deduplicated_documents(docs: DataFrame, length: int = 100, home_bytes: int = 4 << 20) -> DataFrame:
    """docs with their kept texts (n_chars follows if there is such a column).

    Rows with one doc_id are told apart by the order of their texts; rows with a null doc_id stay
    as they are, after being seen as the last ones.
    """
    done = dedup_suffixes(docs.select("doc_id", "text"), length, home_bytes=home_bytes, texts=True).where("doc_id IS NOT NULL")
    done = done.select(F.col("doc_id").alias("_id"), F.col("ord").alias("_of"), F.col("kept_text").alias("_kept"))
    given = carried(docs, "doc_id", "text")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("text", F.lit(""))))
    out = given.where("doc_id IS NOT NULL").withColumn("_ord", number).join(done, (F.col("doc_id") == F.col("_id")) & (F.col("_of") - F.col("_ord") == 0))
    changed = {"text": F.col("_kept")} | ({"n_chars": F.char_length("_kept").cast("long")} if "n_chars" in docs.columns else {})
    return restored(out, docs, "doc_id", "text", **changed).unionByName(docs.where("doc_id IS NULL"))
