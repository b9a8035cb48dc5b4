"""Queries of group statistics, sequence statistics and losses over the events table.

A user's events are the sampled responses of one prompt (uid = user_id, row = event_id, score =
value).  Token sequences are a user's events of one day in event order; error events are masked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import groupstats as G
from siftwell.plans.registry import query


def r6(c):
    return F.round(c, 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day: arrays of event ids, values, a second series and masks."""
    e = events(spark, sf_dir)
    item = F.struct("event_id", "value", (F.col("value") / 100 - F.pmod(F.col("event_id"), F.lit(7)) / 10).alias("other"), (F.col("event_type") != "error").cast("int").alias("mask"))
    rows = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(item)).alias("s"))
    return rows.select("user_id", "day", F.col("s.event_id").alias("ids"), F.col("s.value").alias("v"), F.col("s.other").alias("o"), F.col("s.mask").alias("m"))


SEQ = """WITH s AS (
  SELECT event_id, user_id, CAST(ts AS DATE) AS day, value AS v, value / 100 - (event_id % 7) / 10 AS o,
    CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS m,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS pos
  FROM events)
"""


def flat(df: DataFrame, name: str, column, digits: int = 6) -> DataFrame:
    """Array results back to one row per event."""
    return df.withColumn("_x", column).select(F.explode(F.arrays_zip(F.col("ids").alias("event_id"), F.col("_x").alias(name))).alias("z")).select("z.event_id", F.round(f"z.{name}", digits).alias(name))


@query(
    "group_relative_advantage",
    """WITH g AS (SELECT user_id, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY user_id HAVING avg(value) > 30 AND avg(value) < 60)
SELECT e.event_id, e.user_id, e.event_type, round((e.value - g.mean) / (g.std + 1e-6), 6) AS advantage FROM events e JOIN g USING (user_id)""",
)
def _group(spark, sf_dir):
    rows = G.compute_advantage(events(spark, sf_dir), "group", group="user_id", score="value", low=30.0, high=60.0)
    return rows.select("event_id", "user_id", "event_type", r6(F.col("advantage")).alias("advantage"))


@query(
    "batch_normalised_advantage",
    """SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / ((SELECT stddev_samp(value) FROM events) + 1e-6), 6) AS advantage FROM events""",
)
def _batch(spark, sf_dir):
    return G.compute_advantage(events(spark, sf_dir), "batch", group="user_id", score="value").select("event_id", r6(F.col("advantage")).alias("advantage"))


@query(
    "best_of_group_advantage",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn, stddev_samp(value) OVER (PARTITION BY user_id) AS std FROM events),
s AS (SELECT user_id, max(value) FILTER (rn = 1) - max(value) FILTER (rn = 2) AS gain FROM r GROUP BY user_id)
SELECT event_id, round(CASE WHEN rn = 1 THEN gain / (std + 1e-6) ELSE 0 END, 6) AS advantage FROM r JOIN s USING (user_id)""",
)
def _best(spark, sf_dir):
    return G.compute_advantage(events(spark, sf_dir), "best", group="user_id", score="value", key="event_id").select("event_id", r6(F.col("advantage")).alias("advantage"))


@query(
    "leave_one_out_advantage",
    """SELECT event_id, round(value - (sum(value) OVER w - value) / (count(*) OVER w - 1), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)""",
)
def _loo(spark, sf_dir):
    return G.compute_advantage(events(spark, sf_dir), "leave_one_out", group="user_id", score="value").select("event_id", r6(F.col("advantage")).alias("advantage"))


@query(
    "baseline_advantage",
    """SELECT event_id, round(value - b.baseline, 6) AS advantage FROM events LEFT JOIN (SELECT user_id, arg_min(value, event_id) AS baseline FROM events GROUP BY user_id) b USING (user_id)""",
)
def _baseline(spark, sf_dir):
    e = events(spark, sf_dir)
    base = e.groupBy("user_id").agg(F.min_by("value", "event_id").alias("baseline"))
    return G.compute_advantage(e, "baseline", baselines=base, group="user_id", score="value").select("event_id", r6(F.col("advantage")).alias("advantage"))


@query(
    "top_two_per_group",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events)
SELECT user_id, max(value) FILTER (rn = 1) AS best, max(value) FILTER (rn = 2) AS second, max(event_id) FILTER (rn = 1) AS winner FROM r GROUP BY user_id""",
)
def _top2(spark, sf_dir):
    return G.top_two(events(spark, sf_dir), "user_id", "value", "event_id").select("user_id", "best", "second", "winner")


@query("group_filter", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING avg(value) > 45 AND avg(value) < 55)")
def _filter(spark, sf_dir):
    return G.keep_informative_groups(events(spark, sf_dir), "user_id", "value", 45.0, 55.0).select("event_id")


@query("reverse_cumsum", SEQ + "SELECT event_id, round(sum(v) OVER (PARTITION BY user_id, day ORDER BY event_id DESC), 6) AS ret FROM s")
def _revcum(spark, sf_dir):
    return flat(sequences(spark, sf_dir), "ret", G.reverse_cumsum("v"))


@query(
    "discounted_returns",
    SEQ
    + """SELECT a.event_id, round(sum(b.v * pow(0.917, b.pos - a.pos)), 5) AS ret FROM s a JOIN s b ON a.user_id = b.user_id AND a.day = b.day AND b.pos >= a.pos
WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.user_id = a.user_id AND c.day = a.day AND c.m = 0 AND c.pos > a.pos AND c.pos <= b.pos) GROUP BY a.event_id""",
)
def _discounted(spark, sf_dir):
    return flat(sequences(spark, sf_dir), "ret", G.discounted_returns("v", "m", 0.917), 5)


@query(
    "generalised_advantage",
    SEQ
    + """, t AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS k, coalesce(lead(o) OVER (PARTITION BY user_id, day ORDER BY event_id), 0) AS nxt FROM s WHERE m = 1),
d AS (SELECT *, v + 0.9537 * nxt - o AS delta FROM t)
SELECT a.event_id, round(sum(b.delta * pow(0.9537 * 0.917, b.k - a.k)), 5) AS adv FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND b.k >= a.k GROUP BY a.event_id""",
)
def _gae(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("g", G.generalised_advantage("v", "o", "m", 0.9537, 0.917))
    rows = df.select(F.explode(F.arrays_zip("ids", "m", "g")).alias("z")).where("z.m = 1")
    return rows.select(F.col("z.ids").alias("event_id"), F.round("z.g", 5).alias("adv"))


@query(
    "masked_whiten",
    SEQ
    + """, a AS (SELECT sum(v * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM s),
b AS (SELECT sum((v - mean) * (v - mean) * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var, any_value(mean) AS mean FROM s, a)
SELECT event_id, round((v - mean) / sqrt(var + 1e-8), 5) AS white FROM s, b""",
)
def _whiten(spark, sf_dir):
    df = G.masked_whiten(sequences(spark, sf_dir), "v", "m", "w")
    return df.select(F.explode(F.arrays_zip("ids", "w")).alias("z")).select(F.col("z.ids").alias("event_id"), F.round("z.w", 5).alias("white"))


@query("masked_mean_per_sequence", SEQ + "SELECT user_id, day, round(sum(v * m) / (sum(m) + 1e-8), 6) AS mean FROM s GROUP BY user_id, day")
def _mmean(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", "day", r6(G.masked_mean("v", "m")).alias("mean"))


@query(
    "average_loss",
    SEQ
    + """SELECT 'token' AS mode, round(sum(v * m) / (sum(m) + 1e-8), 6) AS loss FROM s
UNION ALL SELECT 'seq', round(avg(x), 6) FROM (SELECT sum(v * m) / (sum(m) + 1e-8) AS x FROM s GROUP BY user_id, day)""",
)
def _loss(spark, sf_dir):
    df = sequences(spark, sf_dir)
    rows = [G.average_loss(df, "v", "m", mode).select(F.lit(mode).alias("mode"), r6(F.col("loss")).alias("loss")) for mode in ("token", "seq")]
    return rows[0].unionByName(rows[1])


@query("response_mask", SEQ + ", f AS (SELECT user_id, day, min(pos) AS stop FROM s WHERE event_id % 5 IN (1, 3) GROUP BY user_id, day) SELECT event_id, CASE WHEN pos <= coalesce(stop, pos) THEN 1 ELSE 0 END AS mask FROM s LEFT JOIN f USING (user_id, day)")
def _rmask(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("tok", F.transform("ids", lambda i: (i % 5).cast("int"))).withColumn("x", G.response_mask("tok", [1, 3]))
    return df.select(F.explode(F.arrays_zip("ids", "x")).alias("z")).select(F.col("z.ids").alias("event_id"), F.col("z.x").alias("mask"))


@query("position_ids", SEQ + "SELECT event_id, CAST(greatest(sum(m) OVER (PARTITION BY user_id, day ORDER BY event_id) - 1, 0) AS INTEGER) AS position FROM s")
def _positions(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("x", G.position_ids("m"))
    return df.select(F.explode(F.arrays_zip("ids", "x")).alias("z")).select(F.col("z.ids").alias("event_id"), F.col("z.x").alias("position"))


# x_k = w^(k-1) v_1 + (1-w) sum w^(k-j) v_j; w is under 0.9, so terms 600 steps back don't show
@query(
    "smoothed_series",
    """WITH d AS (SELECT event_type, event_id, avg(value) AS value FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, 1.8 * (1 / (1 + exp(-0.05 * count(*) OVER (PARTITION BY event_type))) - 0.5) AS w FROM d)
SELECT a.event_type, a.event_id, round(sum(pow(a.w, a.k - b.k) * b.value * CASE WHEN b.k = 1 THEN 1 ELSE 1 - a.w END), 6) AS smoothed FROM o a JOIN o b ON a.event_type = b.event_type AND b.k BETWEEN a.k - 600 AND a.k GROUP BY a.event_type, a.event_id""",
)
def _smooth(spark, sf_dir):
    return G.smooth(events(spark, sf_dir), "event_type", "event_id", "value").select("event_type", "event_id", r6(F.col("smoothed")).alias("smoothed"))


LP = "SELECT event_id, user_id, -value / 100 AS lp, -value / 100 + (event_id % 11 - 5) / 10 AS old, (event_id % 13 - 6.5) / 3 AS adv, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS m FROM events"


def logps(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", "user_id", (-F.col("value") / 100).alias("lp"), (-F.col("value") / 100 + (F.col("event_id") % 11 - 5) / 10).alias("old"), ((F.col("event_id") % 13 - 6.5) / 3).alias("adv"), (F.col("event_type") != "error").cast("int").alias("m"))


@query(
    "kl_estimates",
    f"""WITH l AS ({LP}), k AS (SELECT *, least(greatest(old - lp, -20), 20) AS c FROM l)
SELECT event_id, round(lp - old, 6) AS kl, round(abs(lp - old), 6) AS abs, round(0.5 * (lp - old) * (lp - old), 6) AS mse, round(least(greatest(exp(c) - c - 1, -10), 10), 6) AS low_var_kl FROM k""",
)
def _kl(spark, sf_dir):
    return logps(spark, sf_dir).select("event_id", *(r6(G.kl_estimate(F.col("lp"), F.col("old"), k)).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")))


@query("penalised_reward", f"WITH l AS ({LP}) SELECT event_id, round(adv - 0.05 * (lp - old) * m, 6) AS reward FROM l")
def _penalty(spark, sf_dir):
    return logps(spark, sf_dir).select("event_id", r6(G.penalised_reward(F.col("adv"), F.col("lp"), F.col("old"), F.col("m"), 0.05)).alias("reward"))


@query(
    "policy_losses",
    f"""WITH l AS ({LP}), g AS (SELECT *, (sum((lp - old) * m) OVER (PARTITION BY user_id)) / (sum(m) OVER (PARTITION BY user_id) + 1e-8) AS md FROM l),
r AS (SELECT *, exp(lp - old) AS ratio, exp(least(greatest(lp - old, ln(0.8)), ln(1.3))) AS clipped, exp(md) AS gratio, exp(least(greatest(md, ln(0.8)), ln(1.3))) AS gclipped, CASE WHEN adv >= 0 THEN 1.0 ELSE 1.05 END AS tau FROM g)
SELECT event_id,
 round(CASE WHEN adv < 0 THEN least(greatest(-adv * ratio, -adv * clipped), -adv * 3) ELSE greatest(-adv * ratio, -adv * clipped) END, 6) AS plain,
 round(CASE WHEN adv < 0 THEN least(greatest(-adv * gratio, -adv * gclipped), -adv * 3) ELSE greatest(-adv * gratio, -adv * gclipped) END, 6) AS sequence_level,
 round(-adv * lp * clipped, 6) AS cispo, round(-adv * (4 / tau) / (1 + exp(-tau * (ratio - 1))), 6) AS sapo,
 CASE WHEN -adv * ratio < -adv * clipped THEN 1 ELSE 0 END AS clip_high, CASE WHEN adv < 0 AND greatest(-adv * ratio, -adv * clipped) > -adv * 3 THEN 1 ELSE 0 END AS clip_dual FROM r""",
)
def _policy(spark, sf_dir):
    rows = logps(spark, sf_dir)
    means = rows.groupBy("user_id").agg((F.sum((F.col("lp") - F.col("old")) * F.col("m")) / (F.sum("m") + 1e-8)).alias("md"))
    rows = rows.join(means, "user_id")
    lp, old, adv = F.col("lp"), F.col("old"), F.col("adv")
    high, dual = G.clip_flags(lp, old, adv)
    return rows.select("event_id", r6(G.policy_loss(lp, old, adv)).alias("plain"), r6(G.policy_loss(lp, old, adv, mean_difference=F.col("md"))).alias("sequence_level"), r6(G.policy_loss(lp, old, adv, "cispo")).alias("cispo"), r6(G.policy_loss(lp, old, adv, "sapo")).alias("sapo"), high.alias("clip_high"), dual.alias("clip_dual"))


@query("value_loss", f"WITH l AS ({LP}) SELECT event_id, round(0.5 * greatest(pow(lp - adv, 2), pow(greatest(least(lp, old + 0.5), old - 0.5) - adv, 2)), 10) AS loss FROM l")
def _vloss(spark, sf_dir):
    return logps(spark, sf_dir).select("event_id", F.round(G.value_loss(F.col("lp"), F.col("adv"), F.col("old")), 10).alias("loss"))


@query("adaptive_coefficient", "SELECT event_type, round(ln(0.1) + sum(ln(1 + least(greatest(value / 50.0 - 1, -0.2), 0.2) * 0.1)), 6) AS ln_coefficient FROM events GROUP BY event_type")
def _adaptive(spark, sf_dir):
    return G.adaptive_coefficients(events(spark, sf_dir), "event_type", "value", 0.1, 50.0, 100.0, 10).select("event_type", r6(F.col("ln_coefficient")).alias("ln_coefficient"))


@query(
    "adaptive_coefficient_of_users",
    "SELECT user_id, round(0.1 * product(1 + least(greatest(value / 50.0 - 1, -0.2), 0.2) * 0.1), 6) AS coefficient FROM events GROUP BY user_id",
)
def _adaptive_users(spark, sf_dir):
    """The same fold inside each user's array."""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return e.withColumn("kls", F.col("s.value")).select("user_id", r6(G.adaptive_coefficient("kls", 0.1, 50.0, 100.0, 10)).alias("coefficient"))


@query(
    "preference_losses",
    """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS u, l_suppkey AS s, -l_quantity / 50 - 0.01 AS c, -l_discount * 10 - 0.02 AS r, -l_tax * 8 - 0.3 AS rc, -l_quantity / 60 - 0.4 AS rr FROM lineitem)
SELECT k, n, u, s, round(ln(1 + exp(-(c - r))), 6) AS ranking, round(ln(1 + exp(-0.1 * (c - r - 5.0))), 6) AS simpo, round(ln(1 + exp(-0.1 * (c - r - rc + rr))), 6) AS dpo,
 round(-c + 0.1 * ln(1 + exp(-(c - r - ln(1 - exp(c)) + ln(1 - exp(r))))), 6) AS orpo FROM p""",
)
def _preference(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("s"), (-F.col("l_quantity") / 50 - 0.01).alias("c"), (-F.col("l_discount") * 10 - 0.02).alias("r"), (-F.col("l_tax") * 8 - 0.3).alias("rc"), (-F.col("l_quantity") / 60 - 0.4).alias("rr"))
    c, r = F.col("c"), F.col("r")
    return p.select("k", "n", "u", "s", r6(G.preference_loss(c, r, "ranking")).alias("ranking"), r6(G.preference_loss(c, r, "simpo")).alias("simpo"), r6(G.preference_loss(c, r, "dpo", ref_chosen=F.col("rc"), ref_rejected=F.col("rr"))).alias("dpo"), r6(G.preference_loss(c, r, "orpo")).alias("orpo"))


@query("scaled_token_loss", "SELECT event_id, round(value / 100 * exp(-value / 100), 6) AS loss FROM events")
def _dft(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(G.scaled_token_loss(F.col("value") / 100)).alias("loss"))


@query(
    "masked_logps",
    SEQ + """, n AS (SELECT *, lead(CASE WHEN m = 0 THEN -100 ELSE 1 END) OVER (PARTITION BY user_id, day ORDER BY event_id) AS label FROM s)
SELECT user_id, day, round(coalesce(sum(o) FILTER (label IS NOT NULL AND label <> -100), 0), 6) AS logps FROM n GROUP BY user_id, day""",
)
def _logps(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("labels", F.transform("m", lambda m: F.when(m == 0, -100).otherwise(1)))
    return df.select("user_id", "day", r6(G.masked_logps("o", "labels")).alias("logps"))
