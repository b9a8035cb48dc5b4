"""Best-fit sequence packing by the linear grouping scheme, on length histograms.

Documents become token pieces of at most ``capacity`` tokens.  How full sequences can be made
depends only on how many pieces there are of each length, so the optimisation runs on that
histogram (``capacity`` numbers, whatever the size of the corpus):

1. large lengths are sorted and cut into groups of equal cardinality; each group counts as its
   longest length (linear grouping);
2. the configurations over those few sizes, and how often each is used, come from a linear
   program whose columns are generated by pricing patterns with its duals;
3. the actual pieces of a group take its slots, which leaves real residues;
4. the small lengths and the few pieces that rounding left, longest first, go to the sequences
   with the tightest residue that fits.

The plan is a table of rules (length, rank_start, count, sequence_start, offset): the piece with
rank r among those of its length goes to sequence ``sequence_start + r - rank_start``.  Its size
depends on capacity and groups alone.  Ranks come from per-task counts and one prefix sum, so no
task ever holds all pieces of one length.

Defined cases
    null text: the empty document, one piece that is the end token alone.  null doc_id: kept,
    id null.  Repeated rows: each is packed.  Empty table: no rows.  Extra columns: ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import bounded_batches, materialise


#: (groups, share of the capacity up to which a length is small), from coarse to fine: configurations hold two
#: to three large pieces, and the small ones fill them up.
TRIALS = ((64, 0.25), (256, 0.34), (256, 0.4))


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Uses per size of the most valuable pattern: at most capacity in all, any size as often as it fits."""
    items = capacity // int(sizes.min())
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(items):
        gain = np.where(room >= 0, value[:, None] + best[np.maximum(room, 0)], -1.0)
        pick = gain.argmax(0)
        more = gain[pick, np.arange(capacity + 1)] > best + 1e-12
        chosen.append(np.where(more, pick, -1))
        best = np.where(more, gain[pick, np.arange(capacity + 1)], best)
    uses, left = np.zeros(len(sizes)), capacity
    for pick in reversed(chosen):
        if pick[left] >= 0:
            uses[pick[left]] += 1
            left -= int(sizes[pick[left]])
    return uses


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4, most_steps: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(uses per size, times) of the configurations that meet the demand with the fewest sequences.

    That is a linear program over all patterns: its columns are generated by best_pattern on the
    duals, and it ends when the bound that the duals give lies within ``gap``.  Times are rounded
    down, so at most one sequence's worth of pieces a size is left over.
    """
    single = capacity // sizes
    patterns, inverse, times = [np.eye(len(sizes))[i] * single[i] for i in range(len(sizes))], np.diag(1.0 / single), demand / single
    for _ in range(most_steps):
        dual = inverse.sum(0)
        entering = best_pattern(dual, sizes, capacity)
        worth = float(entering @ dual)
        if worth <= 1 + 1e-9 or times.sum() <= (1 + gap) * float(dual @ demand) / worth:
            break
        column = inverse @ entering
        ratio = np.where(column > 1e-9, times / np.where(column > 1e-9, column, 1.0), np.inf)
        leaving = int(ratio.argmin())
        step = ratio[leaving]
        times = np.maximum(times - step * column, 0.0)
        times[leaving] = step
        row = inverse[leaving] / column[leaving]
        inverse -= np.outer(column, row)
        inverse[leaving] = row
        patterns[leaving] = entering
    return [(p.astype(np.int64), int(t + 1e-6)) for p, t in zip(patterns, times, strict=True) if t + 1e-6 >= 1]


def scheme(counts: np.ndarray, capacity: int, groups: int, small: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rules (length, rank_start, count, sequence_start, offset) that place every piece, and the number of sequences."""
    rules: list[tuple[int, int, int, int, int]] = []
    classes: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by residue: (first sequence, number)
    next_seq = int(counts[capacity])  # whole sequences of one piece
    if next_seq:
        rules.append((capacity, 0, next_seq, 0, 0))
    threshold = int(capacity * small)
    large = [(n, int(counts[n])) for n in range(capacity - 1, threshold, -1) if counts[n]]
    rest: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by length: (first rank, number) to place at the end
    for n in range(1, min(threshold, capacity - 1) + 1):
        if counts[n]:
            rest[n].append((0, int(counts[n])))
    total = sum(c for _, c in large)
    if total:
        each = -(-total // groups)
        sizes: list[int] = []  # a group's longest length
        runs: list[list[list[int]]] = []  # its actual lengths in descending order as [length, first rank, number]
        held = each
        for n, c in large:
            rank = 0
            while c:
                if held == each:
                    held = 0
                    if not sizes or sizes[-1] != n:  # groups of one longest length are one size
                        sizes.append(n)
                        runs.append([])
                take = min(c, each - held)
                runs[-1].append([n, rank, take])
                rank, c, held = rank + take, c - take, held + take
        demand = np.array([sum(x[2] for x in r) for r in runs], np.float64)
        for uses, times in configurations(np.array(sizes), demand, capacity):
            slots = [i for i in range(len(sizes)) for _ in range(int(uses[i]))]
            at = [0] * len(slots)
            pieces = []
            for i in slots:  # the actual pieces that take this slot in the sequences of this configuration
                need, own = times, []
                while need and runs[i]:
                    n, rank, c = runs[i][0]
                    take = min(need, c)
                    own.append([n, rank, take])
                    need -= take
                    if take == c:
                        runs[i].pop(0)
                    else:
                        runs[i][0] = [n, rank + take, c - take]
                if need:  # rounding of the program: fewer pieces than slots
                    own.append([0, 0, need])
                pieces.append(own)
            done, place = 0, [0] * len(slots)
            while done < times:  # stretches of sequences over which every slot's length is the same
                step = min(own[p][2] - a for own, p, a in zip(pieces, place, at, strict=True))
                offset = 0
                for s, own in enumerate(pieces):
                    n, rank, c = own[place[s]]
                    if n:
                        rules.append((n, rank + at[s], step, next_seq + done, offset))
                    offset += n
                    at[s] += step
                    if at[s] == c:
                        place[s], at[s] = place[s] + 1, 0
                classes[capacity - offset].append((next_seq + done, step))
                done += step
            next_seq += times
        for run in runs:
            for n, rank, c in run:
                rest[n].append((rank, c))
    open_residues = sorted(r for r in range(capacity + 1) if classes[r])
    for n in range(capacity - 1, 0, -1):
        for rank, left in rest[n]:
            while left:
                i = bisect.bisect_left(open_residues, n)
                if i == len(open_residues):
                    fresh = -(-left // (capacity // n))
                    classes[capacity].append((next_seq, fresh))
                    next_seq += fresh
                    open_residues.append(capacity)
                residue = open_residues[i]
                first, number = classes[residue].pop()
                if not classes[residue]:
                    open_residues.pop(i)
                take = min(left, number)
                if number > take:
                    if not classes[residue]:
                        bisect.insort(open_residues, residue)
                    classes[residue].append((first + take, number - take))
                rules.append((n, rank, take, first, capacity - residue))
                if not classes[residue - n]:
                    bisect.insort(open_residues, residue - n)
                classes[residue - n].append((first, take))
                left, rank = left - take, rank + take
    return rules, next_seq


def plan(counts: np.ndarray, capacity: int, tolerance: float = 2e-4) -> np.ndarray:
    """Rules [length, rank_start, count, sequence_start, offset] that place every piece.

    The scheme's two parameters, the number of groups and the share of the capacity up to which a
    length is small, are tried from coarse to fine until the sequences are within ``tolerance`` of
    the fewest that could hold all tokens; else the best trial counts.
    """
    counts = np.asarray(counts, np.int64)
    least = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    best: tuple[list, int] | None = None
    for groups, small in TRIALS:
        made = scheme(counts, capacity, groups, small)
        if best is None or made[1] < best[1]:
            best = made
        if best[1] <= least * (1 + tolerance):
            break
    return np.array(sorted(best[0]), np.int64).reshape(-1, 5)


def encoder(tokenizer_path: str, ranks_path: str | None, pattern: str | None, special: dict[str, int] | None) -> Callable[[str], list[int]]:
    """Text to ids; with a rank file of the same vocabulary the faster library makes the same ids."""
    state = {}

    def slow(text: str) -> list[int]:
        if "hf" not in state:
            from tokenizers import Tokenizer

            state["hf"] = Tokenizer.from_file(tokenizer_path)
        return state["hf"].encode(text, add_special_tokens=False).ids

    if ranks_path is None:
        return slow
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # a panic of the library on degenerate texts is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return encode


_PIECES = "pid int, local_rank long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None) -> DataFrame:
    """Pieces of every document, with the task's number and the rank within task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, pattern, special)
        pid, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            cols = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id] if text else [end_id], "<u4")
                n = len(ids)
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for i in range(len(edges) - 1):
                    a, b = edges[i], edges[i + 1]
                    for col, v in zip(cols, (seen[b - a], doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        col.append(v)
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array([pid] * len(cols[0]), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["pid", "local_rank", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, capacity: int, end_id: int, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None, tolerance: float = 2e-4) -> DataFrame:
    """Every piece with its sequence and its offset there.  Text is read once and never shuffled."""
    bounded_batches(docs.sparkSession)
    pieces = materialise(token_pieces(docs, capacity, end_id, tokenizer_path, ranks_path, pattern, special), "pieces")
    by_task = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in totals.items():
        counts[n] = c
    rules = plan(counts, capacity, tolerance)
    before = by_task.select("pid", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    ranked = pieces.join(before, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("local_rank")).alias("rank"))
    first = np.searchsorted(rules[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            order = np.argsort(length, kind="stable")
            which = np.empty(len(length), np.int64)
            edges = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(length) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                n = int(length[rows[0]])
                which[rows] = first[n] + np.searchsorted(rules[first[n] : first[n + 1], 1], rank[rows], side="right") - 1
            own = rules[which] if len(which) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
