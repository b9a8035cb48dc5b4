"""Queries of record converters and validity rules over conversations and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import convert as C
from siftwell.plans.registry import query


def raw(spark, sf_dir):
    """Conversations as one row each, messages in turn order."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("from"), s["text"].alias("value"))).alias("conversations"))


TAGS = {"user": "user", "assistant": "assistant", "observation": "observation", "function": "function", "system": "system"}
STATE = """WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
l AS (SELECT conv_id, max(CASE WHEN k = 1 AND role = 'system' THEN 1 ELSE 0 END) AS lead, max(text) FILTER (k = 1 AND role = 'system') AS system FROM r GROUP BY conv_id),
m AS (SELECT r.conv_id, r.role, r.text, r.k - l.lead - 1 AS i FROM r JOIN l USING (conv_id) WHERE r.k > l.lead),
g AS (SELECT l.conv_id, any_value(l.system) AS system, count(m.i) AS n, coalesce(bool_and(CASE WHEN m.i % 2 = 0 THEN m.role = 'user' ELSE m.role = 'assistant' END), false) AND count(m.i) % 2 = 0 AND count(m.i) > 0 AS good FROM l LEFT JOIN m USING (conv_id) GROUP BY l.conv_id)
"""


@query(
    "sharegpt_canonical",
    STATE
    + """SELECT g.conv_id, CAST(CASE WHEN good THEN n - 1 ELSE 0 END AS INTEGER) AS prompts, CAST(CASE WHEN good THEN 1 ELSE 0 END AS INTEGER) AS responses, coalesce(g.system, '') AS system,
 CASE WHEN good THEN (SELECT text FROM m WHERE m.conv_id = g.conv_id AND m.i = g.n - 1) END AS answer FROM g""",
)
def _sharegpt(spark, sf_dir):
    df = C.converter("sharegpt")(raw(spark, sf_dir), "conv_id", tags=TAGS)
    return df.select("conv_id", F.size("_prompt").alias("prompts"), F.size("_response").alias("responses"), F.col("_system").alias("system"), F.expr("try_element_at(_response, 1).content").alias("answer"))


@query("valid_supervised", STATE + "SELECT conv_id FROM g WHERE good")
def _valid(spark, sf_dir):
    return C.valid_supervised(C.sharegpt(raw(spark, sf_dir), "conv_id", tags=TAGS)).select("conv_id")


@query("broken_records", STATE + "SELECT count(*) FILTER (NOT good) AS broken, count(*) FILTER (good) AS valid FROM g")
def _broken(spark, sf_dir):
    df = C.sharegpt(raw(spark, sf_dir), "conv_id", tags=TAGS)
    return df.agg(F.count_if(F.size("_response") == 0).alias("broken"), F.count_if(F.size("_response") > 0).alias("valid"))


@query("sharegpt_v1_messages", "SELECT conv_id, CAST(count(*) AS INTEGER) AS messages, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS DOUBLE) AS weight FROM conversations GROUP BY conv_id")
def _v1(spark, sf_dir):
    df = C.sharegpt_v1(raw(spark, sf_dir), "conv_id", tags=TAGS)
    return df.select("conv_id", F.size("messages").alias("messages"), F.expr("aggregate(messages, 0D, (a, m) -> a + m.loss_weight)").alias("weight"))


def pairs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("output"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("instruction"))
    return u.join(a, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("id"), "instruction", F.when(F.col("turn") % 4 == 1, F.lit("extra")).otherwise(F.lit("")).alias("input"), "output", (F.col("turn") % 4 == 3).alias("label"))


PAIRS = "WITH p AS (SELECT a.conv_id, a.turn, u.text AS q, a.text AS o, CASE WHEN a.turn % 4 = 1 THEN 'extra' ELSE '' END AS x FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') "


@query("alpaca_canonical", PAIRS + "SELECT conv_id, turn, CASE WHEN x = '' THEN q WHEN q = '' THEN x ELSE q || chr(10) || x END AS prompt, o AS response FROM p")
def _alpaca(spark, sf_dir):
    df = C.alpaca(pairs(spark, sf_dir), "id")
    return df.select("id.conv_id", "id.turn", F.col("_prompt")[0]["content"].alias("prompt"), F.col("_response")[0]["content"].alias("response"))


@query("alpaca_feedback", PAIRS + "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN o ELSE '' END AS first, CASE WHEN turn % 4 = 3 THEN '' ELSE o END AS second FROM p")
def _feedback(spark, sf_dir):
    df = C.alpaca(pairs(spark, sf_dir), "id", kind="feedback")
    return df.select("id.conv_id", "id.turn", F.col("_response")[0]["content"].alias("first"), F.col("_response")[1]["content"].alias("second"))


@query("alpaca_v1_messages", PAIRS + "SELECT conv_id, turn, CASE WHEN q || x <> '' THEN 'user=' || q || x || chr(10) ELSE '' END || CASE WHEN o <> '' THEN 'assistant=' || o || chr(10) ELSE '' END AS messages FROM p")
def _alpaca_v1(spark, sf_dir):
    df = C.alpaca_v1(pairs(spark, sf_dir), "id")
    return df.select("id.conv_id", "id.turn", F.expr("array_join(transform(messages, m -> concat(m.role, '=', m.content[0].value, '\n')), '')").alias("messages"))


@query("placeholder_check", "SELECT conv_id, turn, (length(text) - length(replace(text, 'en', ''))) // 2 = 3 AS ok FROM conversations")
def _placeholders(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", C.placeholders_match(F.col("text"), F.array(F.lit("a"), F.lit("b"), F.lit("c")), "en").alias("ok"))


@query("expand_placeholder", "SELECT item_id, replace(text, '. ', '##') AS text FROM benchmark")
def _expand(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n = F.size(F.split("text", r"\. ")) - 1
    return b.select("item_id", C.expand_placeholder(F.col("text"), r"\. ", "#", F.array_repeat(F.lit(2), n)).alias("text"))


@query("without_thought", "SELECT item_id, text FROM benchmark")
def _thought(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select("item_id", C.without_thought(C.with_thought(F.col("text"))).alias("text"))
