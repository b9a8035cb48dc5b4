"""Queries of truncation, masks, padding, blocks and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import tokens as T
from siftwell.plans.registry import query


def turns(spark, sf_dir):
    """Prompt and response of every answered turn, as letters' codes."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", T.byte_ids("prompt").alias("p"), T.byte_ids("response").alias("r"))


def shown(ids):
    """Ids as one string: two hex digits or more each, -- for an ignored one."""
    return F.array_join(F.transform(ids, lambda x: F.when(x == T.IGNORE, "--").when(x > 255, F.hex(x)).otherwise(F.lpad(F.hex(x), 2, "0"))), "")


BUDGET = """WITH t AS (SELECT a.conv_id, a.turn, hex(u.text) AS uh, hex(a.text) AS ah, greatest(strlen(u.text), 1) AS s, {t} AS t FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
b AS (SELECT *, CASE WHEN t * 2 < {c} THEN {c} WHEN s * 2 < {c} THEN {c} - s ELSE CAST(trunc({c} * t / (s + t)) AS BIGINT) END AS most FROM t),
c AS (SELECT *, least(most, t) AS kt, least(greatest({c} - least(most, t), 0), s) AS ks FROM b),
k AS (SELECT *, substr(uh, 1, 2 * ks) AS prompt, substr(ah, 1, 2 * kt) AS reply, repeat('--', ks) AS ignored FROM c)
"""
ANSWER, LONGER = "greatest(strlen(a.text), 1)", "greatest(strlen(a.text), strlen(u.text), 1)"


@query("truncation_budget", BUDGET.format(c=500, t=ANSWER) + "SELECT conv_id, turn, CAST(ks AS BIGINT) AS source, CAST(kt AS BIGINT) AS target FROM k")
def _budget(spark, sf_dir):
    s, t = T.truncation(F.size("p"), F.size("r"), 500)
    return turns(spark, sf_dir).select("conv_id", "turn", s.alias("source"), t.alias("target"))


@query("supervised_encoding", BUDGET.format(c=499, t=ANSWER) + "SELECT conv_id, turn, prompt || reply || '100' AS ids, ignored || reply || '100' AS labels, CAST(ks + kt + 1 AS INTEGER) AS attended FROM k")
def _supervised(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("e", T.supervised("p", "r", 500, end_id=256))
    return rows.select("conv_id", "turn", shown("e.input_ids").alias("ids"), shown("e.labels").alias("labels"), F.aggregate("e.attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"))


# the prompt itself stands for the rejected answer; the longer answer decides the budget
@query(
    "pairwise_encoding",
    BUDGET.format(c=300, t=LONGER) + "SELECT conv_id, turn, prompt || reply AS chosen, ignored || reply AS chosen_labels, prompt || substr(uh, 1, 2 * kt) AS rejected, ignored || substr(uh, 1, 2 * kt) AS rejected_labels FROM k",
)
def _pairwise(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("e", T.pairwise("p", "r", "p", 300))
    return rows.select("conv_id", "turn", shown("e.chosen_input_ids").alias("chosen"), shown("e.chosen_labels").alias("chosen_labels"), shown("e.rejected_input_ids").alias("rejected"), shown("e.rejected_labels").alias("rejected_labels"))


@query(
    "unpivot_pairs",
    BUDGET.format(c=300, t=LONGER) + "SELECT conv_id, turn, 0 AS part, prompt || reply AS ids, ignored || reply AS labels FROM k UNION ALL SELECT conv_id, turn, 1, prompt || substr(uh, 1, 2 * kt), ignored || substr(uh, 1, 2 * kt) FROM k",
)
def _unpivot(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("e", T.pairwise("p", "r", "p", 300)).select(F.struct("conv_id", "turn").alias("key"), "e.*")
    return T.unpivot_pairs(rows, "key").select("key.conv_id", "key.turn", "part", shown("input_ids").alias("ids"), shown("labels").alias("labels"))


@query(
    "feedback_shift",
    """WITH n AS (SELECT event_id, event_type, floor(event_id / 100) AS b, row_number() OVER (PARTITION BY floor(event_id / 100) ORDER BY event_id) AS k, count(*) OVER (PARTITION BY floor(event_id / 100)) AS c FROM events)
SELECT a.event_id, b.event_type AS shifted FROM n a JOIN n b ON a.b = b.b AND b.k = CASE WHEN a.k = 1 THEN a.c ELSE a.k - 1 END""",
)
def _shift(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.floor(F.col("event_id") / 100).alias("b"))
    return T.feedback_shift(e, "b", "event_id", "event_type", "shifted").select("event_id", "shifted")


@query("fit_left", "SELECT conv_id, turn, CAST(40 AS INTEGER) AS n, CAST(greatest(40 - greatest(strlen(text), 1), 0) AS INTEGER) AS pads FROM conversations")
def _fit(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("i", T.byte_ids("text")).withColumn("f", T.fit("i", 40, -1, left_pad=True, truncation="left"))
    return c.select("conv_id", "turn", F.size("f").alias("n"), F.size(F.filter("f", lambda x: x == -1)).alias("pads"))


@query("pad_to_batch", "SELECT conv_id, turn, CAST(ceil(max(greatest(strlen(text), 1)) OVER (PARTITION BY conv_id) / 8) * 8 AS INTEGER) AS n FROM conversations")
def _pad(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("i", T.byte_ids("text"))
    return T.pad_to_batch(c, "conv_id", "i", 0, 8).select("conv_id", "turn", F.size("i").alias("n"))


def segments(spark, sf_dir):
    """Rows of packed segment numbers: the lines of an order, numbered by part modulo 4 (0 is padding)."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.pmod("l_partkey", F.lit(4)).cast("int"))).alias("seg"))
    return rows


SEG = "WITH s AS (SELECT l_suppkey, l_partkey % 4 AS seg, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey % 4) - 1 AS i FROM lineitem) "


@query("segment_lengths", SEG + "SELECT l_suppkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY seg) AS lengths FROM (SELECT l_suppkey, seg, count(*) AS n FROM s WHERE seg > 0 GROUP BY ALL) GROUP BY l_suppkey")
def _seglen(spark, sf_dir):
    return segments(spark, sf_dir).select("l_suppkey", F.array_join(T.segment_lengths("seg").cast("array<string>"), ",").alias("lengths"))


@query("block_causal_mask", SEG + "SELECT l_suppkey, CAST(coalesce(sum(n * (n + 1) // 2) FILTER (seg <> 0), 0) AS BIGINT) AS seen FROM (SELECT l_suppkey, seg, count(*) AS n FROM s GROUP BY ALL) GROUP BY l_suppkey")
def _mask(spark, sf_dir):
    """A segment of n tokens has n * (n + 1) / 2 ones."""
    rows = segments(spark, sf_dir)
    rows = rows.repartition(spark.sparkContext.defaultParallelism * 4, "l_suppkey").withColumn("m", T.block_causal_mask("seg"))
    return rows.select("l_suppkey", F.expr("aggregate(m, 0L, (a, r) -> a + aggregate(r, 0L, (b, x) -> b + x))").alias("seen"))


@query(
    "pretrain_blocks",
    """WITH c AS (SELECT conv_id, string_agg(hex(text), '' ORDER BY turn) AS h FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(b AS INTEGER) AS block, '100' || substr(h, 128 * b + 3, 126) AS ids FROM c, range(100000) r(b) WHERE b < strlen(h) // 128""",
)
def _blocks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("i", T.byte_ids("text"))
    return T.pretrain_blocks(c, "conv_id", "turn", "i", 64, begin_id=256).select("conv_id", "block", shown("input_ids").alias("ids"))


@query("rotate_leading_pads", "SELECT l_suppkey, CAST(count(*) FILTER (l_partkey % 4 = 0) AS INTEGER) AS pads, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_suppkey")
def _rotate(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("x", T.rotate_leading_pads("seg", 0))
    # padding now stands at the end only
    tail = F.size("x") - F.expr("coalesce(array_max(transform(x, (v, i) -> if(v != 0, i + 1, 0))), 0)")
    return rows.select("l_suppkey", tail.cast("int").alias("pads"), F.size("x").alias("n"))


@query(
    "frame_indices",
    """WITH n AS (SELECT p_partkey, p_size * 10 AS total, CAST(least(p_size * 10, 64, greatest(1, floor(p_size / 3.0 * 2))) AS INTEGER) AS n FROM part)
SELECT p_partkey, array_to_string([CAST(floor(i * CASE WHEN n > 1 THEN (total - 1) / (n - 1) ELSE 0 END + 1e-9) AS INTEGER) FOR i IN range(n)], ',') AS frames FROM n""",
)
def _frames(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("f", T.frame_indices(F.col("p_size") * 10, F.col("p_size") / 3, 2.0, 64))
    return p.select("p_partkey", F.array_join(F.col("f").cast("array<string>"), ",").alias("frames"))


def lengths(spark, sf_dir):
    """Documents by thousands, with their number of words."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.floor(F.col("doc_id") / 1000).alias("batch"), F.size(F.split("text", " ")).alias("n"))


LENGTHS = "d AS (SELECT doc_id, CAST(floor(doc_id / 1000) AS BIGINT) AS batch, len(string_split(text, ' ')) AS n FROM documents)"


@query(
    "knapsack_packing",
    f"""WITH RECURSIVE {LENGTHS}, s AS (SELECT batch, list({{'n': n, 'k': doc_id}} ORDER BY n, doc_id) AS rest FROM d WHERE n <= 2048 GROUP BY batch),
f AS (SELECT batch, rest, 0 AS bin, CAST(2048 AS BIGINT) AS room, 0 AS place, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS n FROM s
 UNION ALL SELECT batch, [x FOR x IN rest IF x.k <> pick.k], bin + fresh, CASE WHEN fresh = 1 THEN 2048 ELSE room END - pick.n, CASE WHEN fresh = 1 THEN 0 ELSE place END + 1, pick.k, pick.n
 FROM (SELECT *, CASE WHEN len(fits) = 0 THEN 1 ELSE 0 END AS fresh, CASE WHEN len(fits) = 0 THEN rest[-1] ELSE fits[-1] END AS pick FROM (SELECT *, [x FOR x IN rest IF x.n <= room] AS fits FROM f WHERE len(rest) > 0)))
SELECT batch, doc_id, CAST(bin AS INTEGER) AS bin, CAST(place - 1 AS INTEGER) AS place, CAST(2048 - room - n AS INTEGER) AS start FROM f WHERE doc_id IS NOT NULL""",
)
def _knapsack(spark, sf_dir):
    return T.knapsack(lengths(spark, sf_dir), "batch", "doc_id", "n", 2048)


@query("differencing_partitions")
def _differencing(spark, sf_dir):
    return T.balanced_partitions(lengths(spark, sf_dir), "batch", "doc_id", "n", 8)


@query(
    "least_loaded_partitions",
    f"""WITH RECURSIVE {LENGTHS}, o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id) AS k FROM d),
f AS (SELECT DISTINCT batch, CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT) FOR i IN range(8)] AS sums, CAST(NULL AS BIGINT) AS doc_id, 0 AS part FROM d
 UNION ALL SELECT f.batch, o.k, [sums[i] + CASE WHEN i = list_position(sums, list_min(sums)) THEN o.n ELSE 0 END FOR i IN range(1, 9)], o.doc_id, list_position(sums, list_min(sums)) - 1 FROM f JOIN o ON o.batch = f.batch AND o.k = f.k + 1)
SELECT batch, doc_id, CAST(part AS INTEGER) AS part FROM f WHERE doc_id IS NOT NULL""",
)
def _least_loaded(spark, sf_dir):
    return T.balanced_partitions(lengths(spark, sf_dir), "batch", "doc_id", "n", 8, method="greedy")


@query("micro_batches")
def _micro(spark, sf_dir):
    return T.micro_batches(lengths(spark, sf_dir), "batch", "doc_id", "n", 20000)


@query("balance_report", "WITH p AS (SELECT doc_id % 8 AS p, sum(len(string_split(text, ' '))) AS n FROM documents GROUP BY 1) SELECT CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, CAST(max(n) - min(n) AS BIGINT) AS difference FROM p")
def _report(spark, sf_dir):
    return T.balance_report(lengths(spark, sf_dir).withColumn("p", F.col("doc_id") % 8), "p", "n")


USERS = "WITH u AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1), p AS (SELECT user_id, ids, (-len(ids)) % 4 + CASE WHEN (-len(ids)) % 4 < 0 THEN 4 ELSE 0 END AS padding FROM u)"


def _by_user(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids")).withColumn("labels", F.col("ids"))


@query(
    "sequence_shards",
    USERS
    + """, f AS (SELECT user_id, padding, (len(ids) + padding) // 4 AS each, list_concat(ids, list_transform(range(padding), lambda x: 0)) AS ids, list_concat(list_concat(ids[2:], [-100]), list_transform(range(padding), lambda x: -100)) AS labels FROM p)
SELECT user_id, CAST(rank AS INTEGER) AS rank, CAST(padding AS INTEGER) AS padding, array_to_string(ids[rank * each + 1 : (rank + 1) * each], ' ') AS ids, array_to_string(labels[rank * each + 1 : (rank + 1) * each], ' ') AS labels FROM f, (SELECT unnest([0, 1, 2, 3]) AS rank)""",
)
def _shards(spark, sf_dir):
    """Every user's events as one sequence, cut for four ranks."""
    s = T.sequence_shards(_by_user(spark, sf_dir), {"ids": 0, "labels": -100}, 4, "labels")
    return s.select("user_id", "rank", "padding", *(F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("ids", "labels")))


@query("gathered_shards", USERS + " SELECT user_id, array_to_string(ids, ' ') AS ids FROM u")
def _gathered(spark, sf_dir):
    s = T.sequence_shards(_by_user(spark, sf_dir), {"ids": 0, "labels": -100}, 4, "labels")
    return T.gathered_shards(s, ["user_id"], ["ids"]).select("user_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
