"""Length, accuracy, throughput and training metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_cdf(df: DataFrame, length: str, interval: int) -> DataFrame:
    """Bucket start, count, running count and share of rows up to the bucket.  Buckets are few, rows are not."""
    g = df.groupBy((F.floor(F.col(length) / interval) * interval).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    return g.select("bucket", "n", run.alias("running"), (run / total * 100).alias("percent"))


def accuracy_by_category(df: DataFrame, category: str, correct: Column) -> DataFrame:
    """Percent right per category and, as Average, over all questions."""
    g = df.rollup(category).agg(F.grouping(category).alias("_all"), F.avg(correct.cast("double")).alias("a"))
    return g.select(F.when(F.col("_all") == 1, "Average").otherwise(F.col(category)).alias("category"), F.round(F.col("a") * 100, 2).alias("accuracy"))


def length_metrics(df: DataFrame, length: str, most: int) -> DataFrame:
    """mean, max, min and the share of rows at the limit."""
    return df.agg(F.avg(length).alias("mean"), F.max(length).alias("max"), F.min(length).alias("min"), F.avg((F.col(length) >= most).cast("double")).alias("clip_ratio"))


def data_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean, max, min."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s"))
    return stacked.groupBy(F.col("s.name").alias("name")).agg(F.avg("s.v").alias("mean"), F.max("s.v").alias("max"), F.min("s.v").alias("min"))


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained"))


def reduce_metrics(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(F.avg(value).alias("mean"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def merge_partial_means(df: DataFrame, name: str, total: str, count: str) -> DataFrame:
    """Partial sums and counts of many workers, merged and then divided."""
    return df.groupBy(name).agg((F.sum(total) / F.sum(count)).alias("mean"))


def timing_per_token(seconds: Column, tokens: Column) -> Column:
    return seconds * 1000 / tokens


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return tokens / (seconds * devices)


def tokens_per_second(df: DataFrame, length: str, epochs: float, runtime: float, world: int) -> DataFrame:
    return df.agg((F.sum(length) * epochs / runtime / world).alias("tokens_per_second"))


def dense_flops(df: DataFrame, length: str, parameters: int, head_dim: int, heads: int, layers: int, seconds: float) -> DataFrame:
    """Achieved teraflops of a dense transformer step: 6 N tokens + 12 sum(len^2) d h l."""
    return df.agg(((6.0 * parameters * F.sum(length) + 12.0 * F.sum(F.col(length) * F.col(length)) * head_dim * heads * layers) / seconds / 1e12).alias("teraflops"))


def expert_parameters(hidden: int, layers: int, vocabulary: int, heads: int, kv_heads: int, head_dim: int, expert_width: int, used_experts: int, experts: int) -> int:
    """Parameters that a token of a mixture-of-experts model passes."""
    attention = hidden * (heads + 2 * kv_heads) * head_dim + heads * head_dim * hidden
    return layers * (attention + 3 * hidden * expert_width * used_experts + hidden * experts) + 2 * vocabulary * hidden


def learning_rate(valid_ratio: float, cutoff: int, batch: int, small: bool = False) -> float:
    """3e-4 scaled by the root of valid tokens a batch against four million; a sixth for some families."""
    lr = 3e-4 * (cutoff * batch * valid_ratio / 4_000_000) ** 0.5
    return lr / 6 if small else lr


def label_ratio(df: DataFrame, labels: str, ignore: int = -100) -> DataFrame:
    return df.agg((F.sum(F.size(F.filter(labels, lambda x: x != ignore))) / F.sum(F.size(labels))).alias("ratio"))


def token_accuracy(df: DataFrame, predictions: str, labels: str, ignore: int = -100) -> DataFrame:
    """Mean over rows of the share of next tokens predicted right (labels shifted by one)."""
    pairs = F.filter(F.arrays_zip(F.slice(predictions, F.lit(1), F.size(predictions) - 1).alias("p"), F.slice(labels, F.lit(2), F.size(labels) - 1).alias("l")), lambda z: z["l"] != ignore)
    right = F.size(F.filter(pairs, lambda z: z["p"] == z["l"])) / F.size(pairs)
    return df.agg(F.avg(F.when(F.size(pairs) > 0, right)).alias("accuracy"))


def ranking_accuracy(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return df.agg(F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("accuracy"))


def perplexity(losses: str) -> Column:
    """exp of the mean token loss of a row."""
    return F.exp(F.aggregate(losses, F.lit(0.0), lambda a, x: a + x) / F.size(losses))


def newest_checkpoints(steps: DataFrame, step: str, limit: int, best: int | None = None) -> DataFrame:
    """The newest limit - 1 steps, and always the best one."""
    top = steps.orderBy(F.desc(step)).limit(max(limit - 1, 0))
    return top if best is None else top.unionByName(steps.where(F.col(step) == best)).distinct()


def remaining_time(done: Column, total: Column, elapsed: Column) -> Column:
    return elapsed / done * (total - done)


def duration_text(seconds: Column) -> Column:
    """h:mm:ss"""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


#: Floating-point operations a second that devices promise (dense, half precision), by parts of their names.
DEVICE_FLOPS = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "L40": 181.05e12, "L20": 119.5e12, "H20": 148e12, "910B": 354e12}
UNITS = "BKMGTP"


def device_flops(name: Column, unit: str = "T") -> Column:
    """What a device promises, in thousands per step of the unit; infinite for unknown ones, as the first name that fits says."""
    out = F.lit(float("inf"))
    for part, flops in reversed(DEVICE_FLOPS.items()):
        out = F.when(name.contains(part), flops).otherwise(out)
    return out / float(1000 ** UNITS.index(unit))


def flops_share(achieved: Column, device: Column, devices: int = 1) -> Column:
    """Achieved against promised teraflops."""
    return achieved / (device_flops(device) * devices)
