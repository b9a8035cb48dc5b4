"""Truncation, labels, masks, padding and packing of token sequences.

Sequences are array columns; everything but the block and pack operators stays inside one row.
Operators that the data model defines on batches of rows take the batch as a column (``batch``),
so that they are deterministic under any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.batch import running_before

IGNORE = -100


def truncation(source: Column, target: Column, cutoff: int) -> tuple[Column, Column]:
    """(source length, target length) under a budget that favours the response."""
    cut = F.lit(cutoff)
    most = F.when(target * 2 < cut, cut).when(source * 2 < cut, cut - source).otherwise((cut * target / (source + target)).cast("long"))
    new_target = F.least(most, target)
    return F.least(F.greatest(cut - new_target, F.lit(0)), source).cast("long"), new_target.cast("long")


def truncation_budgets(sources: str, targets: str, cutoff: int) -> Column:
    """For arrays of turn lengths, turn after turn under what is left: array of (source, target) kept."""
    return F.expr(
        f"""aggregate(zip_with({sources}, {targets}, (s, t) -> struct(cast(s as bigint) as s, cast(t as bigint) as t)),
        named_struct('left', cast({cutoff} as bigint), 'out', cast(array() as array<struct<s: bigint, t: bigint>>)),
        (a, x) -> named_struct(
          'left', a.left - least(case when x.t * 2 < a.left then a.left when x.s * 2 < a.left then a.left - x.s else cast(a.left * x.t / (x.s + x.t) as bigint) end, x.t)
            - least(greatest(a.left - least(case when x.t * 2 < a.left then a.left when x.s * 2 < a.left then a.left - x.s else cast(a.left * x.t / (x.s + x.t) as bigint) end, x.t), 0L), x.s),
          'out', if(a.left <= 0, a.out, array_append(a.out, named_struct(
            's', least(greatest(a.left - least(case when x.t * 2 < a.left then a.left when x.s * 2 < a.left then a.left - x.s else cast(a.left * x.t / (x.s + x.t) as bigint) end, x.t), 0L), x.s),
            't', least(case when x.t * 2 < a.left then a.left when x.s * 2 < a.left then a.left - x.s else cast(a.left * x.t / (x.s + x.t) as bigint) end, x.t))))), a -> a.out)"""
    )


def supervised(prompt: str, response: str, cutoff: int, train_on_prompt: bool = False, end_id: int | None = None) -> Column:
    """struct(input_ids, attention_mask, labels) of one turn: prompt labels are ignored unless trained on."""
    room = cutoff - (1 if end_id is not None else 0)
    s, t = (f"cast(size({c}) as bigint)" for c in (prompt, response))
    most = f"(case when {t} * 2 < {room} then {room} when {s} * 2 < {room} then {room} - {s} else cast({room} * {t} / ({s} + {t}) as bigint) end)"
    keep_t = f"least({most}, {t})"
    keep_s = f"least(greatest({room} - {keep_t}, 0), {s})"
    p, r = f"slice({prompt}, 1, cast({keep_s} as int))", f"slice({response}, 1, cast({keep_t} as int))"
    tail = f", array({end_id})" if end_id is not None else ""
    masked = p if train_on_prompt else f"transform({p}, x -> {IGNORE})"
    return F.expr(f"named_struct('input_ids', concat({p}, {r}{tail}), 'attention_mask', transform(concat({p}, {r}{tail}), x -> 1), 'labels', transform(concat({masked}, {r}{tail}), x -> cast(x as bigint)))")


def multi_turn(prompts: str, responses: str, cutoff: int, last_only: bool = False) -> Column:
    """struct(input_ids, labels) of all turns (arrays of id arrays) under one budget.

    Turn after turn takes what is left.  With last_only the newest turns come first for the budget
    and only the last response is trained on.
    """
    p, r = (f"reverse({x})" if last_only else x for x in (prompts, responses))
    s, t = "cast(size(x.p) as bigint)", "cast(size(x.r) as bigint)"
    most = f"(case when {t} * 2 < a.left then a.left when {s} * 2 < a.left then a.left - {s} else cast(a.left * {t} / ({s} + {t}) as bigint) end)"
    keep_t = f"least({most}, {t})"
    keep_s = f"least(greatest(a.left - {keep_t}, 0L), {s})"
    part = f"named_struct('p', slice(x.p, 1, cast({keep_s} as int)), 'r', slice(x.r, 1, cast({keep_t} as int)))"
    kept = f"""aggregate(zip_with({p}, {r}, (p, r) -> named_struct('p', p, 'r', r)), named_struct('left', cast({cutoff} as bigint), 'out', cast(array() as array<struct<p: array<int>, r: array<int>>>)),
      (a, x) -> if(a.left <= 0, a, named_struct('left', a.left - {keep_s} - {keep_t}, 'out', array_append(a.out, {part}))), a -> {'reverse(a.out)' if last_only else 'a.out'})"""
    trained = f"if(i = size({kept}) - 1, x.r, transform(x.r, v -> {IGNORE}))" if last_only else "x.r"
    return F.expr(f"named_struct('input_ids', flatten(transform({kept}, x -> concat(x.p, x.r))), 'labels', flatten(transform({kept}, (x, i) -> concat(transform(x.p, v -> {IGNORE}), {trained}))))")


#: Stage names and the operator that encodes for them.
STAGES = {"pretrain": "pretrain_blocks", "supervised": "supervised", "packed": "knapsack", "ranking": "pairwise", "feedback": "feedback_shift", "generate": "supervised"}


def encoder_for(stage: str):
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}; there are {sorted(STAGES)}")
    return globals()[STAGES[stage]]


def pairwise(prompt: str, chosen: str, rejected: str, cutoff: int) -> Column:
    """struct of chosen and rejected ids and labels: the prompt is cut by the longer response, both responses to one length."""
    s, t = f"cast(size({prompt}) as bigint)", f"cast(greatest(size({chosen}), size({rejected})) as bigint)"
    most = f"(case when {t} * 2 < {cutoff} then {cutoff} when {s} * 2 < {cutoff} then {cutoff} - {s} else cast({cutoff} * {t} / ({s} + {t}) as bigint) end)"
    keep_t = f"least({most}, {t})"
    keep_s = f"least(greatest({cutoff} - {keep_t}, 0), {s})"
    p = f"slice({prompt}, 1, cast({keep_s} as int))"
    c, r = (f"slice({x}, 1, cast({keep_t} as int))" for x in (chosen, rejected))
    ignored = f"transform({p}, x -> {IGNORE})"
    return F.expr(f"named_struct('chosen_input_ids', concat({p}, {c}), 'chosen_labels', concat({ignored}, {c}), 'rejected_input_ids', concat({p}, {r}), 'rejected_labels', concat({ignored}, {r}))")


def feedback_shift(df: DataFrame, batch: str, order: str, column: str, name: str) -> DataFrame:
    """The previous row's value inside a batch; the first row gets the last one's."""
    w = Window.partitionBy(batch).orderBy(order)
    last = F.last(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    number = F.row_number().over(w)
    return df.withColumn(name, F.when(number == 1, last).otherwise(F.lag(column).over(w)))


def unpivot_pairs(df: DataFrame, key: str) -> DataFrame:
    """2n rows: all chosen, then all rejected."""
    return df.select(key, F.lit(0).alias("part"), F.col("chosen_input_ids").alias("input_ids"), F.col("chosen_labels").alias("labels")).unionByName(df.select(key, F.lit(1).alias("part"), F.col("rejected_input_ids").alias("input_ids"), F.col("rejected_labels").alias("labels")))


def pad(ids: str, length: Column | int, fill: int | float, left: bool = False) -> Column:
    """To at least a length."""
    n = F.lit(length) if isinstance(length, int) else length
    extra = F.array_repeat(F.lit(fill), F.greatest(n - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(extra, F.col(ids)) if left else F.concat(F.col(ids), extra)


def fit(ids: str, length: int, fill: int, left_pad: bool = False, truncation: str = "right") -> Column:
    """Padded, or cut on a side; truncation "error" fails while running on longer ones."""
    longer = F.size(ids) > length
    cut = {"left": F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), F.lit(length)), "right": F.slice(ids, F.lit(1), F.lit(length)), "error": F.raise_error(F.lit("sequence is too long")).cast("array<int>")}[truncation]
    return F.when(longer, cut).otherwise(pad(ids, length, fill, left_pad))


def pad_to_batch(df: DataFrame, batch: str, ids: str, fill: int, multiple: int = 1, least: int = 0) -> DataFrame:
    """Every row padded to its batch's longest, rounded up to a multiple."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_n"))
    n = F.ceil(F.greatest(F.col("_n"), F.lit(least)) / multiple) * multiple
    return df.join(longest, batch).withColumn(ids, pad(ids, n, fill)).drop("_n")


def block_causal_mask(segments: str) -> Column:
    """Rows of 1 where token i sees token j: same segment, j <= i, no padding (segment 0)."""
    return F.expr(f"transform({segments}, (_a, _i) -> transform({segments}, (_b, _j) -> if(_a = _b and _a != 0 and _j <= _i, 1, 0)))")


def segment_lengths(segments: str) -> Column:
    """Lengths of segments 1.. in order; absent ones and padding don't count.

    The sorted numbers change where a segment ends, so each length is the distance of two changes.
    """
    own = F.array_sort(F.filter(segments, lambda s: s > 0))
    shifted = F.concat(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), F.array(F.lit(None).cast("int")))
    ends = F.filter(F.transform(F.arrays_zip(own.alias("a"), shifted.alias("b")), lambda z, i: F.when(z["b"].isNull() | (z["a"] != z["b"]), i + 1)), lambda e: e.isNotNull())
    before = F.concat(F.array(F.lit(0)), ends)
    return F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(F.zip_with(ends, F.slice(before, F.lit(1), F.size(ends)), lambda e, b: e - b))


def token_places(df: DataFrame, order: str, segments: str) -> DataFrame:
    """index and place per token that isn't padding: its row-major index in the batch of rows, in order.

    A row's first index follows from the lengths before it, so no task holds the batch.
    """
    rows = running_before(df.select(F.lit(0).alias("_all"), order, segments), "_all", order, F.size(segments).cast("long"), "_at")
    rows = running_before(rows, "_all", order, F.size(F.filter(segments, lambda s: s != 0)).cast("long"), "_kept")
    own = F.filter(F.transform(segments, lambda s, i: F.when(s != 0, i)), lambda i: i.isNotNull())
    return rows.select("_at", "_kept", F.posexplode(own).alias("_k", "_i")).select((F.col("_at") + F.col("_i")).alias("index"), (F.col("_kept") + F.col("_k")).alias("place"))


def cumulative_lengths(df: DataFrame, order: str, segments: str) -> DataFrame:
    """length and end of every segment of a batch of rows in row-major order (end: tokens up to and with it)."""
    rows = df.select(F.lit(0).alias("_all"), order, segment_lengths(segments).alias("_n"))
    rows = running_before(rows, "_all", order, F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x), "_at")
    ends = F.transform("_n", lambda n, i: F.struct(n.alias("n"), F.aggregate(F.slice("_n", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x).alias("end")))
    return rows.select("_at", F.explode(ends).alias("z")).select(F.col("z.n").alias("length"), (F.col("_at") + F.col("z.end")).alias("end"))


def pretrain_blocks(df: DataFrame, batch: str, order: str, ids: str, size: int, begin_id: int | None = None) -> DataFrame:
    """All tokens of a batch of rows in order, cut to blocks; the rest is dropped, a block's first token may be overwritten.

    A row's place follows from the lengths before it.  It is cut into one slice per block that it
    reaches, and only slices are shuffled.
    """
    rows = running_before(df.select(batch, order, ids), batch, order, F.size(ids).cast("long"), "_at")
    total = rows.groupBy(F.col(batch).alias("_batch")).agg((F.floor(F.sum(F.size(ids)) / size) * size).alias("_total"))
    rows = rows.join(total, F.col(batch).eqNullSafe(F.col("_batch"))).where((F.size(ids) > 0) & (F.col("_at") < F.col("_total")))
    last = F.floor((F.least(F.col("_at") + F.size(ids), F.col("_total")) - 1) / size)
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("_at") / size), last)))
    start = F.greatest(F.col("block") * size - F.col("_at"), F.lit(0))  # the slice's first token in the row
    end = F.least((F.col("block") + 1) * size - F.col("_at"), F.size(ids))
    rows = rows.select(batch, F.col("block").cast("int").alias("block"), F.struct((F.col("_at") + start).alias("at"), F.slice(ids, (start + 1).cast("int"), (end - start).cast("int")).alias("t")).alias("s"))
    made = F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]))
    out = rows.groupBy(batch, "block").agg(made.alias("input_ids"))
    if begin_id is not None:
        out = out.withColumn("input_ids", F.concat(F.array(F.lit(begin_id)), F.slice("input_ids", 2, max(size - 1, 1)) if size > 1 else F.array().cast("array<int>")))
    return out


def knapsack(df: DataFrame, batch: str, key: str, length: str, capacity: int) -> DataFrame:
    """key, bin, place, start: the largest that still fits is taken again and again until none does, then the next bin.

    Rows longer than the capacity are left out.  Of equal lengths the largest key goes first.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import bisect

        pdf = pdf[pdf[length] <= capacity].sort_values([length, key])
        held: dict[int, list] = {}  # by length, the largest key last
        for n, k in zip(pdf[length].tolist(), pdf[key].tolist(), strict=True):
            held.setdefault(n, []).append(k)
        lengths = sorted(held)  # at most as many as the capacity, whatever the number of rows
        out, b = [], 0
        while lengths:
            left, place, start = capacity, 0, 0
            while (i := bisect.bisect_right(lengths, left) - 1) >= 0:
                n = lengths[i]
                out.append((held[n].pop(), b, place, start))
                if not held[n]:
                    lengths.pop(i)
                left, place, start = left - n, place + 1, start + n
            b += 1
        made = pd.DataFrame(out, columns=[key, "bin", "place", "start"])
        made[batch] = pdf[batch].iloc[0] if len(pdf) else None
        return made[[batch, key, "bin", "place", "start"]]

    kinds = dict(df.dtypes)
    return df.select(batch, key, length).groupBy(batch).applyInPandas(pack, f"`{batch}` {kinds[batch]}, `{key}` {kinds[key]}, bin int, place int, start int")


def packed_sequences(df: DataFrame, bins: DataFrame, batch: str, key: str, ids: str, labels: str, capacity: int, pad_id: int) -> DataFrame:
    """One row per bin: ids, labels, positions that restart per row, segment numbers; padded to capacity + 1."""
    rows = df.select(batch, key, ids, labels).join(bins, [batch, key])
    g = rows.groupBy(batch, "bin").agg(F.array_sort(F.collect_list(F.struct("place", F.col(ids).alias("i"), F.col(labels).alias("l")))).alias("s"))
    joined = {
        "input_ids": ("flatten(transform(s, x -> x.i))", pad_id),
        "labels": ("flatten(transform(s, x -> x.l))", IGNORE),
        "position_ids": ("flatten(transform(s, x -> transform(x.i, (t, k) -> k)))", 0),
        "segments": ("flatten(transform(s, (x, n) -> transform(x.i, t -> n + 1)))", 0),
    }
    for name, (expr, _) in joined.items():
        g = g.withColumn(name, F.expr(expr))
    return g.select(batch, "bin", *(pad(name, capacity + 1, fill).alias(name) for name, (_, fill) in joined.items()))


def balanced_partitions(df: DataFrame, batch: str, key: str, length: str, parts: int, equal_size: bool = False, method: str = "differencing") -> DataFrame:
    """key and part: k-way number partitioning per batch of rows by largest differencing, or greedily in key order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        lengths = pdf[length].tolist()
        sets = (differencing if method == "differencing" else least_loaded)(lengths, parts, equal_size)
        part = [0] * len(lengths)
        for p, items in enumerate(sets):
            for i in items:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], "part": part})

    kinds = dict(df.dtypes)
    return df.select(batch, key, length).groupBy(batch).applyInPandas(run, f"`{batch}` {kinds[batch]}, `{key}` {kinds[key]}, part int")


def differencing(lengths: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: the two states with the widest spread merge, large sets meeting small ones."""
    import heapq

    items = sorted((n, i) for i, n in enumerate(lengths))
    if equal_size and len(items) % parts:
        raise ValueError("the number of rows must be divisible")

    def state(sets: list[tuple[int, list[tuple[int, int]]]]):
        sets = sorted(sets, key=lambda s: (s[0], len(s[1]), [(i, n) for n, i in s[1]]), reverse=True)
        return (-(sets[0][0] - sets[-1][0]), _Last((sets[0][0], len(sets[0][1]), [(i, n) for n, i in sets[0][1]])), sets)

    heap = []
    step = parts if equal_size else 1
    for a in range(0, len(items), step):
        some = items[a : a + step]
        heap.append(state([(n, [(n, i)]) for n, i in some] + [(0, [])] * (parts - len(some))))
    heapq.heapify(heap)
    while len(heap) > 1:
        x, y = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        heapq.heappush(heap, state([(p[0] + q[0], p[1] + q[1]) for p, q in zip(x, reversed(y), strict=True)]))
    return [sorted(i for _, i in s[1]) for s in heap[0][2]] if heap else [[] for _ in range(parts)]


class _Last:
    """Orders the other way round: of equal spreads the state with the larger first set goes first."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def least_loaded(lengths: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Rows in input order, each to the part with the least sum (and room, if sizes must be equal)."""
    room = len(lengths) // parts if equal_size else len(lengths)
    sets: list[list[int]] = [[] for _ in range(parts)]
    sums = [0] * parts
    for i, n in enumerate(lengths):
        p = min((p for p in range(parts) if len(sets[p]) < room), key=lambda p: sums[p])
        sets[p].append(i)
        sums[p] += n
    return sets


def micro_batches(df: DataFrame, batch: str, key: str, length: str, most_tokens: int) -> DataFrame:
    """key and part: min(n, ceil(sum / most)) differencing parts, numbered by falling sum of squares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        lengths = pdf[length].tolist()
        k = max(1, min(len(lengths), -(-sum(lengths) // most_tokens)))
        sets = differencing(lengths, k)
        sets.sort(key=lambda s: (sum(lengths[i] ** 2 for i in s), min(s) if s else 0), reverse=True)
        part = [0] * len(lengths)
        for p, items in enumerate(sets):
            for i in items:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], "part": part})

    kinds = dict(df.dtypes)
    return df.select(batch, key, length).groupBy(batch).applyInPandas(run, f"`{batch}` {kinds[batch]}, `{key}` {kinds[key]}, part int")


def balance_report(parts: DataFrame, part: str, length: str) -> DataFrame:
    """Least and most tokens of a part, and their difference."""
    sums = parts.groupBy(part).agg(F.sum(length).alias("n"))
    return sums.agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") - F.min("n")).alias("difference"))


def strip_response(ids: str, pad_id: int, eos_is_pad: bool = False) -> Column:
    """A response up to its last token that isn't padding (one more if the end token is the padding); at least one token."""
    last = f"greatest(array_max(transform({ids}, (x, i) -> if(x != {pad_id}, i + 1, 0))), 0)"
    return F.expr(f"slice({ids}, 1, greatest(least({last} + {1 if eos_is_pad else 0}, size({ids})), 1))")


def rotate_leading_pads(ids: str, pad_id: int) -> Column:
    """Leading padding moved to the end; ignored labels count as padding."""
    clean = f"transform({ids}, x -> if(x = {IGNORE}, {pad_id}, x))"
    first = f"coalesce(array_min(transform(filter(transform({clean}, (x, i) -> struct(x, i)), s -> s.x != {pad_id}), s -> s.i)), 0)"
    return F.expr(f"concat(slice({clean}, {first} + 1, size({ids})), slice({clean}, 1, {first}))")


def rechunk(column: str, lengths: str) -> Column:
    """A flat list split by lengths."""
    return F.expr(f"transform({lengths}, (_len, _at) -> slice({column}, 1 + aggregate(slice({lengths}, 1, _at), 0, (_sum, _x) -> _sum + _x), _len))")


def frame_indices(total: Column, seconds: Column, fps: float, most: int) -> Column:
    """Evenly spaced frame numbers, truncated: as many as the seconds ask for, at most ``most`` and ``total``."""
    n = F.least(total, F.lit(most), F.greatest(F.lit(1), F.floor(seconds * fps))).cast("int")
    step = F.when(n > 1, (total - 1) / (n - 1)).otherwise(F.lit(0.0))
    evenly = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * step + F.lit(1e-9)).cast("int"))
    return F.when(total > 0, evenly).otherwise(F.sequence(F.lit(0), F.lit(most - 1)))


def tokenize(df: DataFrame, text: str, out: str, encode) -> DataFrame:
    """Token ids by any ``encode(list of texts) -> list of id lists``, in Arrow batches."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: encode(pdf[text].fillna("").tolist())})

    return df.mapInPandas(run, f"{kinds}, `{out}` array<int>")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_lists(texts: pa.Array) -> pa.Array:
    data = texts.cast(pa.large_binary())
    counts = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
    joined = b"".join(x.as_buffer() for x in data if x.is_valid)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(joined, np.uint8).astype(np.int32)), mask=data.is_null())


def byte_ids(text: str) -> Column:
    """The built-in tokenizer: one id per UTF-8 byte, read off each Arrow batch's bytes at once."""
    return _byte_lists(F.col(text).cast("string"))


def sequence_shards(df: DataFrame, pads: dict[str, object], ranks: int, labels: str | None = None, ignore: int = -100) -> DataFrame:
    """Each sequence as ``ranks`` rows of equal parts, with rank and padding.

    pads names the array columns and what they are filled with to a multiple of ranks.  labels move one place to the left first, so that
    the last token of a part is asked for the first of the next one; the end gets ``ignore``.
    """
    names = list(pads)
    if labels is not None:
        df = df.withColumn(labels, F.when(F.size(labels) > 0, F.concat(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), F.array(F.lit(ignore)))).otherwise(F.col(labels)))
    size = F.greatest(*(F.size(c) for c in names), F.lit(0))
    rows = df.withColumn("padding", F.pmod(-size, F.lit(ranks)).cast("int")).withColumn("_each", ((size + F.col("padding")) / ranks).cast("int"))
    rows = rows.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    kinds = dict(df.dtypes)
    part = lambda c: F.slice(F.concat(F.coalesce(c, F.array().cast(kinds[c])), F.array_repeat(F.lit(pads[c]), F.col("_each") * ranks - F.size(F.coalesce(c, F.array().cast(kinds[c])))).cast(kinds[c])), F.col("rank") * F.col("_each") + 1, F.col("_each"))
    return rows.withColumns({c: part(c) for c in names}).drop("_each")


def gathered_shards(shards: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The sequences of ``sequence_shards`` again, parts in order of rank, without padding; a key meets its parts only."""
    g = shards.groupBy(*keys).agg(F.max("padding").alias("_padding"), F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("_parts"))
    whole = {c: F.flatten(F.col("_parts")[c]) for c in columns}
    return g.select(*keys, *(F.slice(w, F.lit(1), F.size(w) - F.col("_padding")).alias(c) for c, w in whole.items()))
