"""Exact quantiles of large groups by refined histograms, and depth images stretched between them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.geometry import valid_depth
from siftwell.sources.scratch import materialise

#: Bins of a histogram; each pass narrows what holds a rank by this factor at least.
BINS = 4096

# The published polynomials (degrees 0 to 5) of the "turbo" colour map for red, green and blue.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)), F.lit(True))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """keys, n, quantiles: for each share the value at share * (n - 1) of the group in order, between two values by line.

    Nulls and NaN don't count; a group without values is left out.  A pass counts the values of each
    open interval in equal bins, map-side, and keeps the bins that hold a wanted rank with their own
    least and largest value; it ends where they are equal.  No group is sorted or collected: a task
    sees at most ``bins`` rows for an interval.
    """
    inner = [f"_k{i}" for i in range(len(keys))]
    v = df.select(*(F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    place = [(F.col("n").cast("double") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil))))
    spans = materialise(v.groupBy(*inner).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "spans")
    open_ = materialise(spans.select(*inner, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi"), "ranks")
    found = open_.where("lo = hi").select(*inner, "rank", "lo")
    open_ = open_.where("lo < hi")
    while not open_.isEmpty():
        asked = [f"_a{i}" for i in range(len(keys))]
        spots = open_.select(*(F.col(i).alias(a) for i, a in zip(inner, asked, strict=True)), "below", "lo", "hi").distinct()
        rows = v.join(spots, _same(inner, asked) & F.col("_v").between(F.col("lo"), F.col("hi")))
        # halved first: the width of an interval may pass the largest double
        bin_ = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = rows.groupBy(*asked, "below", "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*asked, "lo", "hi").orderBy("bin"))
        counts = counts.withColumn("upto", F.col("below") + upto).select(*asked, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), (F.col("upto") - F.col("c")).alias("from"), "upto", "least", "most")
        met = open_.join(counts, _same(inner, asked) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
        step = materialise(met.select(*inner, "rank", F.col("from").alias("below"), F.col("least").alias("lo"), F.col("most").alias("hi")), "ranks")
        found = found.unionByName(step.where("lo = hi").select(*inner, "rank", "lo"))
        open_ = step.where("lo < hi")
    other = [f"_o{i}" for i in range(len(keys))]
    at = found.groupBy(*(F.col(i).alias(o) for i, o in zip(inner, other, strict=True))).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))

    def between(p: Column) -> Column:
        a, b = (F.element_at("at", f(p).cast("long")) for f in (F.floor, F.ceil))
        return F.when(a == b, a).otherwise(a + (b - a) * (p - F.floor(p)))

    joined = spans.join(at, _same(inner, other))
    return joined.select(*(F.col(i).alias(k) for i, k in zip(inner, keys, strict=True)), "n", F.array(*(between(p) for p in place)).alias("quantiles"))


def depth_range(pixels: DataFrame, image: str = "image_id", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """image, lo, hi: the quantiles of an image's valid depths; of a flat image its least and largest depth (a little more)."""
    valid = pixels.where(valid_depth(F.col("depth")))
    q = exact_quantiles(valid, [image], "depth", (low, high, 0.0, 1.0)).select(image, *(F.col("quantiles")[i].alias(f"_q{i}") for i in range(4)))
    flat = F.col("_q1") - F.col("_q0") < 1e-8
    return q.select(image, F.when(flat, F.col("_q2")).otherwise(F.col("_q0")).alias("lo"), F.when(flat, F.col("_q3") + 1e-8).otherwise(F.col("_q1")).alias("hi"))


def depth_shades(pixels: DataFrame, image: str = "image_id", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds shade (0 to 255, near is bright; 0 for invalid depths) and valid to every pixel with a depth column."""
    span = depth_range(pixels, image, low, high).select(F.col(image).alias("_image"), "lo", "hi")
    rows = pixels.join(span, F.col(image).eqNullSafe(F.col("_image")), "left")
    share = F.greatest(F.least((F.col("depth").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8), F.lit(1.0)), F.lit(0.0))
    ok = valid_depth(F.col("depth"))
    return rows.withColumn("shade", F.when(ok, F.floor((1 - share) * 255).cast("int")).otherwise(0)).withColumn("valid", ok).drop("_image", "lo", "hi")


def turbo(shade: Column) -> Column:
    """red, green, blue of a shade by the polynomials of the colour map."""
    x = shade / 255.0
    channel = lambda cs: F.greatest(F.least(F.bround(255 * sum((F.lit(c) * F.pow(x, F.lit(float(i))) for i, c in enumerate(cs)), F.lit(0.0))), F.lit(255.0)), F.lit(0.0)).cast("int")
    return F.array(*(channel(cs) for cs in TURBO))


def depth_image(pixels: DataFrame, image: str = "image_id", **options: float) -> DataFrame:
    """Adds colour (red, green, blue; black for invalid depths) to every pixel."""
    rows = depth_shades(pixels, image, **options)
    return rows.withColumn("colour", F.when(F.col("valid"), turbo(F.col("shade"))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))).drop("valid", "shade")


def log_sum_exp(values: Column) -> Column:
    """struct(top, rest) of an array of numbers: log(sum(exp)) is top + log(rest); such pairs merge (merged_log_sums)."""
    top = F.array_max(values)
    return F.struct(top.alias("top"), F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)).alias("rest"))


def token_logps(shards: DataFrame, keys: Sequence[str], first: str, logits: str, label: str) -> DataFrame:
    """keys, logp: the log probability of each position's label; null if no shard holds it.

    shards: the vocabulary in parts, rows of (keys, first token number, array of logits, label), so that no row holds it
    whole.  Each part is reduced to its largest logit and a scaled sum before the shuffle; a position then
    meets one pair a part.
    """
    x = F.transform(logits, lambda v: v.cast("double"))
    at = F.col(label) - F.col(first)
    own = F.when((at >= 0) & (at < F.size(logits)), F.get(x, at.cast("int")))
    parts = shards.select(*keys, log_sum_exp(x).alias("_part"), own.alias("_own")).where("_part.top IS NOT NULL")
    g = parts.groupBy(*keys).agg(F.max("_part.top").alias("_top"), F.collect_list("_part").alias("_parts"), F.max("_own").alias("_own"))
    rest = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["rest"] * F.exp(p["top"] - F.col("_top")))
    return g.select(*keys, (F.col("_own") - F.col("_top") - F.log(rest)).alias("logp"))

