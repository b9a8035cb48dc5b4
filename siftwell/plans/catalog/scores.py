"""Queries of answer scoring and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import metrics as M
from siftwell.operators import overlap as O
from siftwell.operators import scoring as S
from siftwell.plans.registry import query
from siftwell.sources.scratch import spread


#: The kinds of the queries below that hold no mathematical answers.
KINDS = tuple(k for k in S.TASKS if k != "math")


def r6(c):
    return F.round(c, 6)


def answers(spark, sf_dir):
    """One made answer per event, of a kind by its number; truths and answers are near each other."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "event_type")
    i, v = F.col("event_id"), F.round("value", 1)
    kind = F.element_at(F.array(*(F.lit(k) for k in ("numerical", "multiple choice", "point", "open-ended"))), (i % 4 + 1).cast("int"))
    point = F.format_string('[{"point_2d": [%d, %d]}]', i % 200 + i % 7 * 20, i % 300)
    truth = F.when(i % 4 == 0, v.cast("string")).when(i % 4 == 1, F.lit("B")).when(i % 4 == 2, F.format_string('[{"point_2d": [%d, %d]}]', i % 200, i % 300)).otherwise(F.col("event_type"))
    given = F.when(i % 4 == 0, F.round(F.col("value") + (i % 3) * 0.01, 2).cast("string")).when(i % 4 == 1, F.element_at(F.array(F.lit("B. yes"), F.lit("A"), F.lit("b")), (i % 3 + 1).cast("int"))).when(i % 4 == 2, point).otherwise(F.when(i % 5 == 0, F.lit("no")).otherwise(F.upper("event_type")))
    response = F.when(i % 9 == 0, given).otherwise(F.concat(F.lit("well <answer> "), given, F.lit(" </answer>")))
    return e.select("event_id", "event_type", kind.alias("kind"), response.alias("response"), truth.alias("truth"))


SCORED = """WITH a AS (SELECT event_id, event_type, event_id % 9 <> 0 AS form,
 CASE event_id % 4 WHEN 0 THEN CASE WHEN round_even(round(value + (event_id % 3) * 0.01, 2), 1) = round_even(round(value, 1), 1) THEN 1.0 ELSE 0.0 END
  WHEN 1 THEN CASE WHEN event_id % 3 <> 1 THEN 1.0 ELSE 0.0 END
  WHEN 2 THEN CASE WHEN (event_id % 7) * 20 < 40 THEN 1.0 WHEN (event_id % 7) * 20 < 150 THEN 1 - ((event_id % 7) * 20 - 40) / 110.0 ELSE 0.0 END
  ELSE CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 1.0 END END AS acc FROM events)
"""


@query("answer_scores", SCORED + "SELECT event_id, round(CASE WHEN form THEN 0.9 * acc + 0.1 ELSE 0 END, 6) AS overall, CAST(CASE WHEN form THEN 1 ELSE 0 END AS DOUBLE) AS format, round(CASE WHEN form THEN acc ELSE 0 END, 6) AS accuracy FROM a")
def _scores(spark, sf_dir):
    a = answers(spark, sf_dir)
    return S.score_rows(a, "response", "truth", "kind", out="s", kinds=KINDS).select("event_id", r6(F.col("s.overall")).alias("overall"), F.col("s.format").alias("format"), r6(F.col("s.accuracy")).alias("accuracy"))


@query("relaxed_scores", SCORED + "SELECT event_id, round(0.9 * acc + CASE WHEN form THEN 0.1 ELSE 0 END, 6) AS overall, round(acc, 6) AS accuracy FROM a")
def _relaxed(spark, sf_dir):
    a = answers(spark, sf_dir)
    return S.score_rows(a, "response", "truth", "kind", relaxed=True, out="s", kinds=KINDS).select("event_id", r6(F.col("s.overall")).alias("overall"), r6(F.col("s.accuracy")).alias("accuracy"))


@query("mean_scores", "SELECT coalesce(event_type, 'all') AS event_type, round(avg(value), 6) AS value FROM events GROUP BY ROLLUP (event_type)")
def _means(spark, sf_dir):
    m = S.mean_scores(spark.read.parquet(f"{sf_dir}/events.parquet"), ["value"], "event_type")
    return m.select("event_type", r6(F.col("value")).alias("value"))


def replies(spark, sf_dir):
    """Every user turn as a reference with the reply to it."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return spread(u.join(a, ["conv_id", "turn"]))


@query("overlap_scores")
def _overlap(spark, sf_dir):
    return O.overlap_scores(replies(spark, sf_dir), "reference", "candidate").drop("reference", "candidate")


#: A made script without spaces: letters as Han characters, everything else left out.
LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


def han(text):
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, HAN)


@query(
    "han_lexicon",
    f"""WITH runs AS (SELECT translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{HAN}') AS run FROM conversations),
grams AS (SELECT size, substr(run, i, size) AS word FROM (SELECT run, size, unnest(range(1, length(run) - size + 2)) AS i FROM runs, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE length(run) >= size)),
counts AS (SELECT word, size, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 5 OR size = 1),
total AS (SELECT sum(n) AS total FROM counts WHERE size = 1),
bonds AS (SELECT c.word, c.n, min(c.n * CAST(total AS DOUBLE) / (CAST(x.n AS DOUBLE) * y.n)) AS bond FROM (SELECT word, n, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c, total, counts x, counts y WHERE x.word = substr(c.word, 1, k) AND y.word = substr(c.word, k + 1) GROUP BY ALL),
held AS (SELECT word, n FROM bonds WHERE bond >= 8 UNION ALL SELECT word, n FROM counts WHERE size = 1)
SELECT word, n FROM held ORDER BY n DESC, encode(word) LIMIT 200000""",
)
def _lexicon(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return O.count_lexicon(spread(c.select("text")).select(han(F.col("text")).alias("t")), "t")


@query("segmented_overlap_scores")
def _segmented(spark, sf_dir):
    r = replies(spark, sf_dir).select("conv_id", "turn", *(han(F.col(c)).alias(c) for c in ("reference", "candidate")))
    texts = r.select(F.explode(F.array("reference", "candidate")).alias("t"))
    return O.overlap_scores(r, "reference", "candidate", O.count_lexicon(texts, "t")).drop("reference", "candidate")


@query("length_cdf", "WITH b AS (SELECT CAST(floor(length(text) / 500) * 500 AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY 1) SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY bucket) * 100.0 / sum(n) OVER (), 6) AS percent FROM b")
def _cdf(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.char_length("text").alias("n_text"))
    return M.length_cdf(d, "n_text", 500).withColumn("percent", r6(F.col("percent")))


@query("accuracy_by_category", "SELECT coalesce(event_type, 'Average') AS category, round(avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM events GROUP BY ROLLUP (event_type)")
def _accuracy(spark, sf_dir):
    return M.accuracy_by_category(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", F.col("value") > 40)


@query("length_metrics", "SELECT round(avg(length(text)), 6) AS mean, CAST(max(length(text)) AS INTEGER) AS max, CAST(min(length(text)) AS INTEGER) AS min, round(avg(CASE WHEN length(text) >= 4000 THEN 1.0 ELSE 0.0 END), 6) AS clip_ratio FROM documents")
def _lengths(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.char_length("text").alias("n"))
    return M.length_metrics(d, "n", 4000).withColumn("mean", r6(F.col("mean"))).withColumn("clip_ratio", r6(F.col("clip_ratio")))


@query("data_metrics", "SELECT 'l_quantity' AS name, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS max, min(l_quantity) AS min FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), max(l_tax), min(l_tax) FROM lineitem")
def _data(spark, sf_dir):
    m = M.data_metrics(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return m.withColumn("mean", r6(F.col("mean")))


@query("explained_variance", "SELECT round(1 - var_samp(l_extendedprice / 1000 - l_quantity) / (var_samp(l_extendedprice / 1000) + 1e-5), 6) AS explained FROM lineitem")
def _explained(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_extendedprice") / 1000).alias("r"), F.col("l_quantity").alias("v"))
    return M.explained_variance(x, "r", "v").select(r6(F.col("explained")).alias("explained"))


@query("reduce_metrics", "SELECT event_type AS name, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _reduce(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "name")
    return M.reduce_metrics(e, "name", "value").withColumn("mean", r6(F.col("mean")))


@query("weighted_mean", "SELECT round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS mean, sum(l_quantity) AS weight FROM lineitem")
def _weighted(spark, sf_dir):
    return M.weighted_mean(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_tax", "l_quantity"), "l_tax", "l_quantity").withColumn("mean", F.round("mean", 9))


@query("merged_partial_means", "SELECT event_type AS name, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _partial(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("name"), (F.col("event_id") % 8).alias("worker")).agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    return M.merge_partial_means(e, "name", "s", "c").withColumn("mean", r6(F.col("mean")))


@query("ranking_accuracy", "SELECT round(avg(CASE WHEN l_discount > l_tax THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem")
def _ranking(spark, sf_dir):
    return M.ranking_accuracy(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_discount", "l_tax"), "l_discount", "l_tax").withColumn("accuracy", r6(F.col("accuracy")))


@query("tokens_per_second", "SELECT round(sum(length(text)) * 3.0 / 60 / 8, 6) AS tokens_per_second FROM documents")
def _tps(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.char_length("text").alias("n"))
    return M.tokens_per_second(d, "n", 3.0, 60.0, 8).withColumn("tokens_per_second", r6(F.col("tokens_per_second")))


@query("dense_flops", "SELECT round((6.0 * 7000000 * sum(length(text)) + 12.0 * sum(CAST(length(text) AS DOUBLE) * length(text)) * 128 * 32 * 32) / 60 / 1e12, 6) AS teraflops FROM documents")
def _flops(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.char_length("text").cast("double").alias("n"))
    return M.dense_flops(d, "n", 7_000_000, 128, 32, 32, 60.0).withColumn("teraflops", r6(F.col("teraflops")))


@query("newest_checkpoints", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 4) UNION SELECT o_orderkey FROM orders WHERE o_orderkey = 10")
def _checkpoints(spark, sf_dir):
    return M.newest_checkpoints(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey", 5, 10)


@query("duration_texts", "SELECT event_id, CAST(event_id // 3600 AS VARCHAR) || ':' || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS t FROM events")
def _durations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", M.duration_text(F.col("event_id")).alias("t"))


@query("perplexity", "SELECT o_custkey, round(exp(avg(o_totalprice / 200000)), 6) AS ppl FROM orders GROUP BY 1")
def _ppl(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.collect_list(F.col("o_totalprice") / 200000).alias("l"))
    return o.select("o_custkey", r6(M.perplexity("l")).alias("ppl"))


@query(
    "task_scores",
    """WITH d AS (SELECT p_partkey, p_size * 3.0 AS d, (p_partkey % 5) * 0.125 AS e, p_size % 11 AS k FROM part),
s AS (SELECT *, CASE WHEN d < 50 THEN 1 WHEN d < 120 THEN 1 - (d - 50) / 70 ELSE 0 END AS flat, CASE WHEN d < 50 THEN 1 WHEN d < 130 THEN 1 - (d - 50) / 80 ELSE 0 END AS deep, CASE WHEN e < 0.1 THEN 1 WHEN e < 0.4 THEN 1 - (e - 0.1) / 0.3 ELSE 0 END AS depth FROM d)
SELECT p_partkey, 'trace' AS kind, round(CAST(flat AS DOUBLE), 6) AS accuracy FROM s UNION ALL SELECT p_partkey, 'trace_3d', round(CAST(0.5 * deep + 0.5 * depth AS DOUBLE), 6) FROM s
UNION ALL SELECT p_partkey, 'spatial grounding', round((10 - k) / CAST(10 + k AS DOUBLE), 6) FROM s UNION ALL SELECT p_partkey, 'point', CAST(CASE WHEN k <= 5 THEN 1 ELSE 0.5 END AS DOUBLE) FROM s""",
)
def _tasks(spark, sf_dir):
    """Tracks, boxes and points at known distances from the truth, by each task's scorer."""
    d, e, k = F.col("p_size") * 3, (F.col("p_partkey") % 5) * 0.125, F.col("p_size") % 11
    track = F.format_string('[{"point_2d": [%d, 5], "depth": %.3f}, {"point_2d": [%d, 9], "depth": %.3f}]', 100 + d, 1 + e, 200 + d, 1 + e)
    line, box = '[{"point_2d": [100, 5], "depth": 1.0}, {"point_2d": [200, 9], "depth": 1.0}]', '[{"bbox_2d": [0, 0, 10, 10]}]'
    tasks = {"trace": (track, line), "trace_3d": (track, line), "spatial grounding": (F.format_string('[{"bbox_2d": [%d, 0, %d, 10]}]', k, 10 + k), box), "point": (F.format_string('[{"point_2d": [1, 1]}, {"point_2d": [%d, 2]}]', k * 2), box)}
    rows = F.array(*(F.struct(F.lit(name).alias("kind"), F.concat(F.lit("<answer>"), a, F.lit("</answer>")).alias("response"), F.lit(t).alias("truth")) for name, (a, t) in tasks.items()))
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")).select("p_partkey", F.inline(rows))
    return S.score_rows(p, "response", "truth", "kind", relaxed=True, out="s", kinds=KINDS).select("p_partkey", "kind", r6(F.col("s.accuracy")).alias("accuracy"))


@query(
    "math_scores",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 90 + 10 AS a, l_suppkey % 7 + 2 AS b, (l_orderkey + l_linenumber) % 8 AS form, l_orderkey % 3 AS off FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN off = 0 OR (form = 4 AND off = 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM l""",
)
def _maths(spark, sf_dir):
    """Answers in eight notations: right ones, wrong ones, and in one notation right but for their order."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 90 + 10).alias("a"), (F.col("l_suppkey") % 7 + 2).alias("b"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("form"), (F.col("l_orderkey") % 3).alias("off"))
    i = i.withColumn("w", F.when(F.col("off") == 0, F.col("a")).otherwise(F.col("a") + F.col("off")))
    f = F.format_string
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    forms = [
        (f(r"\frac{%d}{%d}", a * 6, b * 6), f("%d/%d", w, b)),
        (f("(x+%d)^2", a), f("x^2+%dx+%d", w * 2, a * a)),
        (f(r"\sqrt{%d}", a * a * 2), f(r"%d\sqrt{2}", w)),
        (f("%d.5", a), f(r"\frac{%d}{2}", w * 2 + 1)),
        (f(r"\{%d, %d\}", a, a + 2), F.when(F.col("off") == 1, f("%d, %d", a, a)).otherwise(f("%d, %d", a + 2, a))),
        (f("x=%d", a), f(r"\boxed{%d}", w)),
        (f("[%d, %d)", b, a + 100), f(r"\left[%d,%d\right)", b, w + 100)),
        (f("2x+%dy=%d", b * 2, a * 2), f("x = %d - %dy", w, b)),
    ]
    truth, answer = (F.element_at(F.array(*(x[side] for x in forms)), (F.col("form") + 1).cast("int")) for side in (0, 1))
    rows = i.select("l_orderkey", "l_linenumber", F.lit("math").alias("kind"), truth.alias("truth"), F.concat(F.lit("<answer>"), answer, F.lit("</answer>")).alias("response"))
    return S.score_rows(rows, "response", "truth", "kind", out="s").select("l_orderkey", "l_linenumber", F.col("s.accuracy").alias("accuracy"))


@query(
    "flops_shares",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 989.0 WHEN 1 THEN 119.5 WHEN 2 THEN 148.0 ELSE CAST('inf' AS DOUBLE) END AS promised, round(CASE o_orderkey % 4 WHEN 0 THEN o_totalprice / 1000 / 989 / 2 WHEN 1 THEN o_totalprice / 1000 / 119.5 / 2 WHEN 2 THEN o_totalprice / 1000 / 148 / 2 ELSE 0 END, 9) AS share FROM orders",
)
def _shares(spark, sf_dir):
    device = F.element_at(F.array(*(F.lit(d) for d in ("NVIDIA H100 80GB", "NVIDIA L20", "NVIDIA H20", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", device.alias("device"), (F.col("o_totalprice") / 1000).alias("done"))
    return o.select("o_orderkey", M.device_flops(F.col("device")).alias("promised"), F.round(M.flops_share(F.col("done"), F.col("device"), 2), 9).alias("share"))
