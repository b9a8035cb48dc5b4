"""Sampling, splitting, interleaving and modality batches.

Random order is the order of md5(seed:key): it needs no state, is the same on every run and
partitioning, and keeps top-k selections partial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.batch import with_position
from siftwell.sources.scratch import materialise


def draw(seed: int | str, key: str | Column) -> Column:
    """A fixed pseudo-random string per key; rows are shuffled by ordering on it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def uniform(seed: int | str, key: str | Column) -> Column:
    """A fixed pseudo-random number in [0, 1) per key (52 bits of the same hash)."""
    return F.conv(F.substring(draw(seed, key), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Heads of at most so many rows are a top-k, whose rows meet in one task; larger ones are numbered by ranges.
TOP_ROWS = 10_000


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn without replacement (all, if there are fewer)."""
    if n <= TOP_ROWS:
        return df.orderBy(draw(seed, key), key).limit(n)
    return with_position(df, draw(seed, key), key, name="_drawn").where(F.col("_drawn") < n).drop("_drawn")


def resample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most all rows: a drawn head.  More: all rows once and the rest drawn with replacement."""
    total = df.count()
    if n <= total or not total:
        return shuffled_head(df, key, n, seed).withColumn("_draw", F.lit(0).cast("long"))
    rows = with_position(df, draw(seed, key), key)
    extra = df.sparkSession.range(n - total).select((F.col("id") + 1).alias("_draw"), F.floor(uniform(f"{seed}+", "id") * total).cast("long").alias("_pos"))
    return rows.withColumn("_draw", F.lit(0).cast("long")).unionByName(rows.join(extra, "_pos").select(*rows.columns, "_draw")).drop("_pos")


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def page(df: DataFrame, order: str, index: int, size: int = 2) -> DataFrame:
    """Rows index * size up to (index + 1) * size in order."""
    return df.orderBy(order).offset(index * size).limit(size)


def by_rank(df: DataFrame, group: str, order: str, rank: int) -> DataFrame:
    """Per group the row of a rank from 1, clamped to the group's size.

    The rank limits what each task keeps of a group, before the shuffle and behind it.
    """
    w = Window.partitionBy(group)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(order))).where(F.col("_r") <= max(rank, 1))
    return rows.withColumn("_last", F.max("_r").over(w)).where(F.col("_r") == F.col("_last")).drop("_last", "_r")


def split(df: DataFrame, key: str, validation: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation).  validation over 1 is a number of rows, else a share of them (rounded up)."""
    import math

    n = int(validation) if validation > 1 else math.ceil(validation * df.count())
    held = shuffled_head(df.select(key), key, n, seed)
    return df.join(held, key, "left_anti"), df.join(held, key, "left_semi")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def interleave(frames: Sequence[DataFrame], order: str, strategy: str = "under") -> DataFrame:
    """Rows in turn, one of each source; _at orders them and _source names where each comes from.

    under: until the first source is exhausted; over: until all are, shorter ones start again.
    """
    counts = [f.count() for f in frames]
    n = min(counts) if strategy == "under" else max(counts)
    out = []
    for s, (f, c) in enumerate(zip(frames, counts, strict=True)):
        rows = with_position(f, order)
        if strategy == "under":
            rows = rows.where(F.col("_pos") < n)
        elif c:
            times = -(-n // c)
            rows = rows.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_pos", F.col("_round") * F.lit(c) + F.col("_pos")).where(F.col("_pos") < n).drop("_round")
        out.append(rows.withColumn("_at", F.col("_pos") * len(frames) + s).withColumn("_source", F.lit(s)).drop("_pos"))
    return union_all(out)


def _drawn(spark, probabilities: Sequence[float], n: int, seed: int) -> DataFrame:
    """_at and _source of n draws; each depends on its number and the seed only."""
    total, edges = sum(probabilities), []
    for p in probabilities:
        edges.append((edges[-1] if edges else 0.0) + p)
    source = F.lit(len(probabilities) - 1)
    for s in range(len(probabilities) - 2, -1, -1):
        source = F.when(uniform(seed, "id") < edges[s] / total, s).otherwise(source)
    return spark.range(n).select(F.col("id").alias("_at"), source.alias("_source"))


def interleave_by_probability(frames: Sequence[DataFrame], order: str, probabilities: Sequence[float], n: int | None = None, seed: int = 42, stop: str = "first") -> DataFrame:
    """Draw i takes its source by a fixed random number, and that source's next row (again from its start when exhausted).

    Without a number of draws they end with the last row of the source that is exhausted first (stop = "first"), or of
    the last one that was not exhausted yet ("all"; sources that are never drawn don't count).  A source without rows is exhausted
    at once: with "first" nothing is drawn, with "all" it is left out.
    """
    spark = frames[0].sparkSession
    sizes = [f.count() for f in frames]
    if n is None and stop == "all":
        probabilities = [p if c else 0.0 for p, c in zip(probabilities, sizes, strict=True)]
    live = [s for s, p in enumerate(probabilities) if p > 0]
    places: dict[int, DataFrame] = {}

    def number(upto: int) -> None:
        draws = _drawn(spark, probabilities, upto, seed)
        places.update({s: materialise(with_position(draws.where(F.col("_source") == s), "_at"), "draws") for s in live})

    if n is not None:
        number(n)
    elif not live or (stop == "first" and min(sizes[s] for s in live) == 0):
        n = 0
        number(0)
    else:
        need = [sizes[s] * sum(probabilities) / probabilities[s] for s in live]
        upto = int((min(need) if stop == "first" else max(need)) * 1.1) + 100
        while n is None:
            number(upto)
            ends = [places[s].where(F.col("_pos") == sizes[s] - 1).first() for s in live]  # at most one row each
            done = [e["_at"] for e in ends if e is not None]
            if done if stop == "first" else len(done) == len(live):
                n = (min(done) if stop == "first" else max(done)) + 1
            upto *= 2
    out = []
    for s, f in enumerate(frames):
        rows = with_position(f, order)
        mine = places[s].where(F.col("_at") < n).withColumn("_pos", F.col("_pos") % max(sizes[s], 1)) if s in places else rows.select(F.lit(0).cast("long").alias("_at"), F.lit(s).alias("_source"), "_pos").limit(0)
        out.append(mine.join(rows, "_pos").drop("_pos"))
    return union_all(out)


def capped_sample(df: DataFrame, source: str, key: str, caps: dict[str, int], seed: int = 42) -> DataFrame:
    """Per source at most its cap of rows, drawn; sources without a cap stay whole."""
    parts = [shuffled_head(df.where(F.col(source) == name), key, n, seed) for name, n in caps.items()]
    return union_all([*parts, df.where(~F.col(source).isin(list(caps)) | F.col(source).isNull())])


def modality_batches(df: DataFrame, modality: str, key: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Full batches of one modality each (the rest of a modality is dropped); plan is a batch's place in the shuffled plan.

    One numbering by (modality, draw) serves all modalities; each one's first number and count are an aggregation.
    """
    s = seed + epoch
    rows = with_position(df.where(F.col(modality).isNotNull()), modality, draw(s, key), key)
    spans = rows.groupBy(modality).agg(F.min("_pos").alias("_first"), (F.floor(F.count(F.lit(1)) / size) * size).alias("_full"))
    rows = rows.join(spans, modality).withColumn("_pos", F.col("_pos") - F.col("_first"))
    rows = rows.where(F.col("_pos") < F.col("_full")).withColumn("batch", F.floor(F.col("_pos") / size).cast("int")).drop("_pos", "_first", "_full")
    plan = spans.where("_full > 0").select(modality, F.explode(F.sequence(F.lit(0), (F.col("_full") / size - 1).cast("int"))).alias("batch"))
    plan = with_position(plan, draw(f"{s}plan", F.concat(F.col(modality), F.lit("#"), F.col("batch").cast("string"))), name="plan")
    return rows.join(plan, [modality, "batch"])


def skip_consumed(batches: DataFrame, consumed: int) -> DataFrame:
    """Resume: batches whose place in the plan was not used yet."""
    return batches.where(F.col("plan") >= consumed)


def buffered_shuffle(df: DataFrame, order: str, key: str, buffer: int = 16384, seed: int = 42) -> DataFrame:
    """_at orders rows: shuffled inside consecutive buffers, as a bounded stream shuffle does."""
    rows = with_position(df, order).withColumn("_block", F.floor(F.col("_pos") / buffer))
    return with_position(rows, "_block", draw(seed, key), key, name="_at").drop("_pos", "_block")


def minibatches(df: DataFrame, order: str, size: int, epochs: int) -> DataFrame:
    """Rows of every epoch with epoch and batch numbers."""
    rows = with_position(df, order).withColumn("batch", F.floor(F.col("_pos") / size).cast("int")).drop("_pos")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
