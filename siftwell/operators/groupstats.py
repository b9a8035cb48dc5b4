"""Group-relative statistics over sampled responses, and token-level sequence statistics.

Group operators are window expressions on one shuffle by the group column.  Token operators work
on array columns inside one row (no shuffle); ``mask`` arrays hold 1 for tokens that count.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import scans as S
from siftwell.operators.batch import with_position
from siftwell.sources.scratch import materialise

EPS = 1e-6

# ---- group level --------------------------------------------------------------------------


def keep_informative_groups(df: DataFrame, group: str, score: str, low: float, high: float) -> DataFrame:
    """Rows of groups whose mean score lies strictly between low and high.

    The groups are found by a partial aggregation, then met by a semi join: a hot group's rows
    are never brought together.
    """
    good = df.groupBy(group).agg(F.avg(score).alias("_mean")).where((F.col("_mean") > low) & (F.col("_mean") < high)).select(group)
    return df.join(good, group, "left_semi")


def _with_group(df: DataFrame, group: str, score: str) -> DataFrame:
    """Joins count, sum and sample deviation of each group; aggregates are combined map-side."""
    stats = df.groupBy(group).agg(F.count(score).alias("_n"), F.sum(score).alias("_sum"), F.stddev_samp(score).alias("_std"))
    return df.join(stats, group)


def group_normalised(df: DataFrame, group: str, score: str, eps: float = EPS, low: float | None = None, high: float | None = None) -> DataFrame:
    """(score - group mean) / (group deviation + eps).

    With low or high only groups whose mean lies strictly between them stay: the same statistics
    filter and normalise, in one aggregation and one join.
    """
    mean = F.col("_sum") / F.col("_n")
    stats = df.groupBy(group).agg(F.count(score).alias("_n"), F.sum(score).alias("_sum"), F.stddev_samp(score).alias("_std"))
    if low is not None:
        stats = stats.where(mean > low)
    if high is not None:
        stats = stats.where(mean < high)
    return df.join(stats, group).withColumn("advantage", (F.col(score) - mean) / (F.col("_std") + eps)).drop("_n", "_sum", "_std")


def batch_normalised(df: DataFrame, group: str, score: str, eps: float = EPS) -> DataFrame:
    """(score - group mean) / (deviation of the whole batch + eps)."""
    rows = _with_group(df, group, score).crossJoin(F.broadcast(df.agg(F.stddev_samp(score).alias("_all"))))  # one row
    return rows.withColumn("advantage", (F.col(score) - F.col("_sum") / F.col("_n")) / (F.col("_all") + eps)).drop("_n", "_sum", "_std", "_all")


def top_two(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Best and second score per group and the winner's key (ties: smallest key).

    The rank limit is applied before the shuffle, so two rows a group and task travel.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    two = df.select(group, score, key).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    best = two.groupBy(group).agg(F.max(F.when(F.col("_r") == 1, F.col(score))).alias("best"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("second"), F.max(F.when(F.col("_r") == 1, F.col(key))).alias("winner"))
    spread = df.groupBy(group).agg(F.stddev_samp(score).alias("std"), F.count(F.lit(1)).alias("n"))
    return best.join(spread, group)


def best_of_group(df: DataFrame, group: str, score: str, key: str, eps: float = EPS) -> DataFrame:
    """Only the best row counts: (best - second) / (deviation + eps); all others 0."""
    two = top_two(df, group, score, key)
    gain = F.when(F.col(key) == F.col("winner"), (F.col("best") - F.col("second")) / (F.col("std") + eps)).otherwise(0.0)
    return df.join(two, group).withColumn("advantage", gain).drop("best", "second", "winner", "std", "n")


def leave_one_out(df: DataFrame, group: str, score: str) -> DataFrame:
    """score - mean of the group's other rows."""
    rows = _with_group(df, group, score)
    return rows.withColumn("advantage", F.col(score) - (F.col("_sum") - F.col(score)) / (F.col("_n") - 1)).drop("_n", "_sum", "_std")


def against_baseline(df: DataFrame, baselines: DataFrame, group: str, score: str, baseline: str = "baseline") -> DataFrame:
    """score - the group's baseline (greedy response's reward)."""
    return df.join(baselines, group, "left").withColumn("advantage", F.col(score) - F.col(baseline))


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_estimator(name: str, fn: Callable[..., DataFrame]) -> None:
    if name in ESTIMATORS:
        raise ValueError(f"estimator {name} is registered already")
    ESTIMATORS[name] = fn


for _name, _fn in (("group", group_normalised), ("batch", batch_normalised), ("best", best_of_group), ("leave_one_out", leave_one_out), ("baseline", against_baseline)):
    register_estimator(_name, _fn)


def compute_advantage(df: DataFrame, estimator: str, **columns) -> DataFrame:
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](df, **columns)


# ---- token level (array columns of one row) -----------------------------------------------


def reverse_cumsum(values: str) -> Column:
    """Suffix sums in one backward pass."""
    return S.over(S.reversed_sums, "array<double>", values)


def discounted_returns(rewards: str, mask: str, gamma: float) -> Column:
    """G_t = r_t + gamma * G_{t+1}; what is carried on is multiplied by the mask after use."""
    return S.over(S.discounted(gamma), "array<double>", rewards, mask)


def generalised_advantage(rewards: str, values: str, mask: str, gamma: float, lam: float) -> Column:
    """Backward recurrence; masked steps carry the state on."""
    return S.over(S.advantages(gamma, lam), "array<double>", rewards, values, mask)


def masked_sum(values: str, mask: str) -> Column:
    return F.expr(f"aggregate(zip_with({values}, {mask}, (v, m) -> v * m), 0D, (a, x) -> a + x)")


def mask_size(mask: str) -> Column:
    return F.expr(f"aggregate({mask}, 0D, (a, x) -> a + x)")


def masked_mean(values: str, mask: str, eps: float = 1e-8) -> Column:
    return masked_sum(values, mask) / (mask_size(mask) + eps)


def masked_moments(df: DataFrame, values: str, mask: str, eps: float = 1e-8) -> DataFrame:
    """One row: masked mean and unbiased variance over all tokens (biased if at most one counts)."""
    sums = df.select(masked_sum(values, mask).alias("s"), F.expr(f"aggregate(zip_with({values}, {mask}, (v, m) -> v * v * m), 0D, (a, x) -> a + x)").alias("q"), mask_size(mask).alias("n"))
    one = sums.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / (F.col("n") + eps)
    var = F.col("q") / (F.col("n") + eps) - 2 * mean * F.col("s") / (F.col("n") + eps) + mean * mean * F.col("n") / (F.col("n") + eps)
    return one.select("n", mean.alias("mean"), F.when(F.col("n") > 1, var * F.col("n") / (F.col("n") - 1)).otherwise(var).alias("var"))


def masked_whiten(df: DataFrame, values: str, mask: str, out: str, eps: float = 1e-8) -> DataFrame:
    """(v - mean) / sqrt(var + eps) with moments over the whole batch (a one-row broadcast)."""
    moments = F.broadcast(masked_moments(df, values, mask, eps).select(F.col("mean").alias("_m"), F.col("var").alias("_v")))
    return df.crossJoin(moments).withColumn(out, F.transform(values, lambda v: (v - F.col("_m")) / F.sqrt(F.col("_v") + eps))).drop("_m", "_v")


def average_loss(df: DataFrame, values: str, mask: str, mode: str = "token", eps: float = 1e-8) -> DataFrame:
    """token: masked mean over all tokens; seq: mean of each row's masked mean."""
    if mode == "token":
        return df.select(masked_sum(values, mask).alias("s"), mask_size(mask).alias("n")).agg((F.sum("s") / (F.sum("n") + eps)).alias("loss"))
    if mode == "seq":
        return df.agg(F.avg(masked_mean(values, mask, eps)).alias("loss"))
    raise ValueError(f"unknown mode {mode}")


def response_mask(ids: str, eos: int | list[int]) -> Column:
    """1 up to and including the first end token, 0 behind it."""
    stops = [eos] if isinstance(eos, int) else eos
    found = [F.array_position(ids, e) for e in stops]
    first = F.least(*(F.when(p > 0, p) for p in found), F.size(ids).cast("long"), F.size(ids).cast("long")).cast("int")
    return F.concat(F.array_repeat(F.lit(1), first), F.array_repeat(F.lit(0), F.size(ids) - first))


def position_ids(mask: str) -> Column:
    """max(running count of the mask - 1, 0)."""
    return S.over(S.counted_places, "array<int>", mask)


def _starts(blocks: DataFrame, most: int, size: int) -> DataFrame:
    """_key, _block, _start: what the maps x to x * f + own of a series' blocks before each one come to.

    blocks: _key, _block, f, own, at most ``most`` of a series.  More than ``size`` of them are put together to
    blocks of blocks first, so that no row holds more than size.
    """
    whole = F.array_sort(F.collect_list(F.struct("_block", "f", "own"))).alias("b")
    if most <= size:
        held = blocks.groupBy("_key").agg(whole).withColumn("_from", F.lit(0.0))
    else:
        held = materialise(blocks.groupBy("_key", F.floor(F.col("_block") / size).alias("_of")).agg(whole), "blocks")
        outer = held.select("_key", F.col("_of").alias("_block"), F.expr("aggregate(b, 1D, (a, x) -> a * x.f)").alias("f"), F.expr("aggregate(b, 0D, (a, x) -> a * x.f + x.own)").alias("own"))
        before = _starts(outer, -(-most // size), size).select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.col("_start").alias("_from"))
        held = held.join(before, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_of") == F.col("_b"))).select("_key", "b", "_from")
    # the start stands in front of the maps, as one that gives it whatever it gets
    run = S.over(S.affine, "array<double>", F.concat(F.array(F.lit(0.0)), F.col("b.f")), F.concat(F.array("_from"), F.col("b.own")))
    return held.withColumn("e", run).select("_key", F.inline(F.arrays_zip(F.col("b._block").alias("_block"), F.slice("e", F.lit(1), F.size("b")).alias("_start"))))


def smooth(df: DataFrame, key: str, order: str, value: str, block: int = 512, fan: int = 512) -> DataFrame:
    """Exponential moving average per series; the weight follows from the series' length: 1.8 * (sigmoid(0.05 n) - 0.5).

    A series is folded in blocks of consecutive rows, and its blocks in blocks of blocks: each starts from what
    those before it come to, so no row of the plan holds more than ``block`` rows or ``fan`` blocks (two at least).
    """
    rows = with_position(df.select(key, order, value), key, order, value)
    series = materialise(rows.groupBy(F.col(key).alias("_key")).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")), "series")
    most = series.agg(F.max("_n")).first()[0] or 0
    rows = rows.join(series, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_block", F.floor((F.col("_pos") - F.col("_first")) / block))
    s = F.array_sort(F.collect_list(F.struct("_pos", F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    rows = rows.groupBy("_key", "_block", "_n").agg(s.alias("s")).withColumn("w", F.expr("1.8D * (1D / (1D + exp(-0.05D * _n)) - 0.5D)"))
    rows = materialise(rows, "blocks")
    # a block takes x to x * w ** size + own; the first one starts from its first value
    own = F.expr("aggregate(s, if(_block = 0, s[0].v, 0D), (a, x) -> a * w + (1D - w) * x.v)")
    maps = rows.select("_key", "_block", F.expr("if(_block = 0, 0D, pow(w, size(s)))").alias("f"), own.alias("own"))
    starts = _starts(maps, -(-most // block), max(fan, 2)).select(F.col("_key").alias("_of"), F.col("_block").alias("_at"), F.when(F.col("_block") > 0, F.col("_start")).alias("_end"))
    rows = rows.join(starts, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")))
    folded = S.over(S.moving_averages, "array<double>", F.col("s.v"), F.col("w"), F.col("_end"))
    return rows.withColumn("e", folded).select(F.col("_key").alias(key), F.explode(F.arrays_zip(F.col("s.o").alias(order), F.col("e").alias("smoothed"))).alias("z")).select(key, F.col(f"z.{order}"), "z.smoothed")


# ---- losses -------------------------------------------------------------------------------


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def kl_estimate(a: Column, b: Column, kind: str) -> Column:
    """Divergence estimate of log probability a against reference b."""
    if kind == "kl":
        return a - b
    if kind == "abs":
        return F.abs(a - b)
    if kind == "mse":
        return 0.5 * (a - b) * (a - b)
    if kind == "low_var_kl":
        k = clamp(b - a, -20.0, 20.0)
        return clamp(F.exp(k) - k - 1, -10.0, 10.0)
    raise ValueError(f"unknown kind {kind}")


def penalised_reward(score: Column, a: Column, b: Column, mask: Column, coefficient: float, kind: str = "kl") -> Column:
    return score - coefficient * kl_estimate(a, b, kind) * mask


def policy_loss(log_prob: Column, old: Column, advantage: Column, kind: str = "default", low: float = 0.2, high: float = 0.3, dual: float = 3.0, tau_positive: float = 1.0, tau_negative: float = 1.05, mean_difference: Column | None = None) -> Column:
    """Per token.  mean_difference is the row's masked mean of log_prob - old (the gspo kinds)."""
    d = log_prob - old if mean_difference is None else mean_difference
    ratio = F.exp(clamp(d, -20.0, 20.0))
    clipped = F.exp(clamp(d, math.log(1 - low), math.log(1 + high)))
    if kind == "cispo":
        return -advantage * log_prob * clipped
    if kind == "sapo":
        tau = F.when(advantage >= 0, tau_positive).otherwise(tau_negative)
        return -advantage * (F.lit(4.0) / tau) / (1 + F.exp(-tau * (ratio - 1)))
    first, second, third = -advantage * ratio, -advantage * clipped, -advantage * dual
    upper = F.greatest(first, second)
    return F.when(advantage < 0, F.least(upper, third)).otherwise(upper)


def clip_flags(log_prob: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.3, dual: float = 3.0) -> tuple[Column, Column]:
    """Whether the upper clip, and whether the dual clip took hold."""
    d = log_prob - old
    first = -advantage * F.exp(clamp(d, -20.0, 20.0))
    second = -advantage * F.exp(clamp(d, math.log(1 - low), math.log(1 + high)))
    upper = F.greatest(first, second)
    return (first < second).cast("int"), ((upper > -advantage * dual) & (advantage < 0)).cast("int")


def value_loss(prediction: Column, returns: Column, value: Column, clip: float = 0.5) -> Column:
    clipped = F.greatest(F.least(prediction, value + clip), value - clip)
    a, b = (prediction - returns) * (prediction - returns), (clipped - returns) * (clipped - returns)
    return 0.5 * F.greatest(a, b)


def adaptive_coefficients(df: DataFrame, key: str, kl: str, start: float, target: float, horizon: float, steps: int) -> DataFrame:
    """adaptive_coefficient of every key's rows.  Its steps are factors, so their order doesn't matter and
    logarithms are summed map-side; ln_coefficient stays finite where the product of many steps wouldn't."""
    factor = 1 + clamp(F.col(kl) / target - 1, -0.2, 0.2) * (steps / horizon)
    rows = df.groupBy(key).agg((F.lit(math.log(start)) + F.sum(F.log(factor))).alias("ln_coefficient"))
    return rows.select(key, F.exp("ln_coefficient").alias("coefficient"), "ln_coefficient")


def adaptive_coefficient(kls: str, start: float, target: float, horizon: float, steps: int) -> Column:
    """A fold over the divergences seen: coef *= 1 + clip(kl / target - 1, +-0.2) * steps / horizon."""
    return F.expr(f"aggregate({kls}, {start!r}D, (c, k) -> c * (1D + least(greatest(k / {target!r}D - 1D, -0.2D), 0.2D) * {steps / horizon!r}D))")


def preference_loss(chosen: Column, rejected: Column, kind: str, beta: float = 0.1, gamma: float = 0.5, ref_chosen: Column | None = None, ref_rejected: Column | None = None) -> Column:
    """dpo, simpo, orpo (average log probabilities below 0) and ranking losses of one pair."""
    if kind == "ranking":
        return -log_sigmoid(chosen - rejected)
    if kind == "simpo":
        return -log_sigmoid(beta * (chosen - rejected - gamma / beta))
    if kind == "orpo":
        odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
        return -chosen + beta * -log_sigmoid(odds)
    if kind == "dpo":
        return -log_sigmoid(beta * ((chosen - rejected) - (ref_chosen - ref_rejected)))
    raise ValueError(f"unknown kind {kind}")


def scaled_token_loss(loss: Column) -> Column:
    """loss * exp(-loss): each token's cross entropy weighed by its own probability."""
    return loss * F.exp(-loss)


def masked_logps(logps: str, labels: str, ignore: int = -100) -> Column:
    """Sum of next-token log probabilities over labels that count (labels shifted by one)."""
    return F.expr(f"aggregate(zip_with(slice({logps}, 1, greatest(size({logps}) - 1, 0)), slice({labels}, 2, greatest(size({labels}) - 1, 0)), (p, l) -> if(l = {ignore}, 0D, p)), 0D, (a, x) -> a + x)")


def counted_labels(labels: str, ignore: int = -100) -> Column:
    """How many next-token labels count."""
    return F.size(F.filter(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != ignore))


def discounted_logps(logps: str, labels: str, public: Column, alpha: float, ignore: int = -100) -> Column:
    """masked_logps in which tokens beyond the first ``public`` places after the first counted label weigh alpha.

    public is the smaller number of counted labels of a pair's two answers.
    """
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    counts = F.transform(F.slice(labels, F.lit(2), n), lambda x: (x != ignore).cast("int"))
    weighed = F.transform(F.arrays_zip(F.slice(logps, F.lit(1), n).alias("p"), counts.alias("c")), lambda z, i: F.struct(z["p"].alias("p"), z["c"].alias("c"), i.alias("i")))
    first = F.greatest(F.array_position(counts, 1) - 1, F.lit(0))
    state = F.struct((first + public).cast("long").alias("edge"), F.lit(0.0).alias("sum"))
    step = lambda a, z: F.struct(a["edge"].alias("edge"), (a["sum"] + F.when(z["c"] == 0, 0.0).when(z["i"] < a["edge"], z["p"]).otherwise(alpha * z["p"])).alias("sum"))
    return F.aggregate(weighed, state, step, lambda a: a["sum"])


def moving_baseline_loss(chosen: Column, rejected: Column, baseline: Column, beta: float = 0.1) -> Column:
    """Binary classifier loss of a pair: both rewards against a running mean of earlier rewards."""
    return -log_sigmoid(beta * chosen - baseline) - log_sigmoid(baseline - beta * rejected)


def running_baseline(rewards: str, start: float = 0.0) -> Column:
    """The running means before each reward of an array, started at a value."""
    return S.over(S.means_before(start), "array<double>", rewards)


def place_score(score: str, mask: str) -> Column:
    """A token array that holds the score at the last token that counts, 0 elsewhere."""
    last = f"array_max(transform({mask}, (_flag, _i) -> if(_flag = 1, _i, -1)))"
    return F.expr(f"transform({mask}, (_seen, _at) -> if(_at = {last}, cast({score} as double), 0D))")


def last_counted(values: str, mask: str) -> Column:
    """The value at the last token that counts; null if none does."""
    return F.expr(f"get({values}, array_max(transform({mask}, (_flag, _i) -> if(_flag = 1, _i, -1))))")


def nan_skipping(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Per kind the sums and counts of what isn't NaN."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    return df.groupBy(kind).agg(*(F.sum(v).alias(f"{c}_sum") for c, v in clean.items()), *(F.count(v).alias(f"{c}_count") for c, v in clean.items()))
