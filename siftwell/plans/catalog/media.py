"""Queries of point decoding, media arithmetic, dispatch and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import points as P
from siftwell.functions import templates as M
from siftwell.functions import tools as K
from siftwell.operators import dispatch as D
from siftwell.operators import media as A
from siftwell.operators import media_tokens as Z
from siftwell.operators import infer as N
from siftwell.plans.registry import query


def parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


@query("decoded_points", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 1000 AS DOUBLE) AS y FROM part")
def _decode(spark, sf_dir):
    p = parts(spark, sf_dir)
    forms = ['[{"point_2d": [%d, %d]}]', "see (%d, %d)", "<points>[[%d, %d]]</points>", "```json\n[%d, %d]\n```"]
    text = F.element_at(F.array(*(F.format_string(f, F.col("p_size"), F.col("p_partkey") % 1000) for f in forms)), (F.col("p_partkey") % 4 + 1).cast("int"))
    d = p.select("p_partkey", F.explode(P.decode_points(text)).alias("p"))
    return d.select("p_partkey", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("frame_ranges", "SELECT p_partkey, CAST(ceil(p_size * 0.125 * 25) AS BIGINT) AS first, CAST(least(floor((p_size * 0.125 + 2) * 25), 199) AS BIGINT) AS last FROM part")
def _ranges(spark, sf_dir):
    p = parts(spark, sf_dir)  # sizes go to 50; the video ends at 8 s, inside the longest ranges
    r = A.frame_range(F.lit(200), F.lit(25.0), F.col("p_size") * 0.125, F.col("p_size") * 0.125 + 2)
    return p.withColumn("r", r).select("p_partkey", "r.first", "r.last")


@query("visual_token_counts", "SELECT p_partkey, CAST(floor(2 * p_size * 6 / 4) AS INTEGER) AS n FROM part")
def _visual(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", A.visual_tokens(F.array(F.lit(2), F.col("p_size"), F.lit(6))).alias("n"))


@query("short_prompts", "SELECT item_id FROM benchmark WHERE length(text) <= 300")
def _short(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("n", F.length("text"))
    return A.keep_short(b, "n", 300).select("item_id")


@query("dispatched_sums", "WITH n AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM n GROUP BY floor(pos / (n / 5))")
def _dispatch(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return D.dispatch(o, "o_orderkey", 5, lambda p: p.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("once_per_key", "SELECT o_orderkey, o_custkey * 2 AS doubled FROM orders")
def _once(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return D.once_per_key(o, "o_custkey", [], lambda d: d.withColumn("doubled", F.col("o_custkey") * 2)).select("o_orderkey", "doubled")


def chats(spark, sf_dir):
    """Conversations with their system text apart; turns in order."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "role", "text"))))
    return c.groupBy("conv_id").agg(F.transform(turns, lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content"))).alias("m"), F.min(F.when(F.col("role") == "system", F.col("text"))).alias("system"))


CHATS = """WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations WHERE role <> 'system'),
y AS (SELECT conv_id, min(text) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id)
"""


@query(
    "rendered_chats",
    CHATS
    + """SELECT conv_id, string_agg(CASE WHEN i = 0 THEN '<|im_start|>system' || chr(10) || CASE WHEN coalesce(system, '') = '' THEN 'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.' ELSE system END || '<|im_end|>' || chr(10) ELSE '' END ||
 CASE WHEN role = 'user' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE text || '<|im_end|>' || chr(10) END, '' ORDER BY i) AS text
FROM r LEFT JOIN y USING (conv_id) GROUP BY conv_id""",
)
def _render(spark, sf_dir):
    c = chats(spark, sf_dir).where("size(m) > 0")
    return c.select("conv_id", F.array_join(M.render("m", M.resolve("qwen"), "system"), "").alias("text"))


def _slots() -> str:
    """All templates as SQL rows: name and slots, tokens filled in."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for name, t in M.TEMPLATES.items():
        tokens = lambda s, t=t: s.replace("{{bos}}", "<s>").replace("{{eos}}", M.end_of(t, "</s>"))
        rows.append(f"({', '.join(q(x) for x in (name, tokens(t.prefix), tokens(t.system), tokens(t.user), tokens(t.reply), t.default_system))}, {t.system_in_first_user})")
    return "t(template, prefix, sys, usr, rep, own, inside) AS (VALUES " + ",\n".join(rows) + ")"


@query(
    "rendered_by_all_templates",
    CHATS
    + ", "
    + _slots()
    + """, s AS (SELECT *, CASE WHEN i > 0 THEN '' ELSE CASE WHEN coalesce(system, '') = '' THEN own ELSE system END END AS asked FROM r LEFT JOIN y USING (conv_id), t),
h AS (SELECT *, CASE WHEN asked = '' THEN '' ELSE replace(sys, '{{content}}', asked) END AS head, replace(CASE WHEN role = 'user' THEN usr ELSE rep END, '{{idx}}', CAST(i // 2 AS VARCHAR)) AS slot FROM s)
SELECT conv_id, template, md5(string_agg(CASE WHEN i = 0 THEN prefix ELSE '' END || CASE WHEN inside AND role = 'user' THEN replace(slot, '{{content}}', head || text) WHEN inside THEN replace(slot, '{{content}}', text) ELSE head || replace(slot, '{{content}}', text) END, '' ORDER BY i)) AS digest
FROM h GROUP BY conv_id, template""",
)
def _render_all(spark, sf_dir):
    """Every conversation by each of the templates."""
    c = chats(spark, sf_dir).where("size(m) > 0")
    made = [F.struct(F.lit(name).alias("template"), F.md5(F.array_join(M.render("m", t, "system", "</s>"), "")).alias("digest")) for name, t in M.TEMPLATES.items()]
    return c.select("conv_id", F.inline(F.array(*made)))


@query("read_tool_calls", "SELECT event_id, event_type AS name FROM events")
def _calls(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.format_string("Action: %s\nAction Input: %s", "event_type", "props").alias("text"))
    return K.with_calls(e, "text").select("event_id", F.col("calls")[0]["name"].alias("name"))


@query(
    "media_placeholders",
    """WITH p AS (SELECT p_partkey, 2 + 2 * (p_size % 4) AS h, 4 + 2 * (p_partkey % 3) AS w, 1 + p_size % 3 AS n FROM part)
SELECT p_partkey, 'a<|vision_start|>' || repeat('<|image_pad|>', h * w // 4) || '<|vision_end|>b' AS grid, 'a<img>' || repeat('<IMG_CONTEXT>', n * 16) || '</img>b' AS tiles,
 'a' || repeat(repeat('[IMG]', w) || '[IMG_BREAK]', h - 1) || repeat('[IMG]', w) || '[IMG_END]b' AS rows, 'a' || repeat('<image>', h * w) || 'b' AS patches, 'aPicture 1:<|IMAGE_START|><|image@placeholder|><|IMAGE_END|>b' AS numbered FROM p""",
)
def _media(spark, sf_dir):
    """One image in a text, by the rules of five models."""
    h, w = (2 + 2 * (F.col("p_size") % 4)).cast("long"), (4 + 2 * (F.col("p_partkey") % 3)).cast("long")
    medium = F.struct(F.array(F.lit(1).cast("long"), h, w).alias("grid"), (h * 14).alias("height"), (w * 14).alias("width"), F.array((1 + F.col("p_size") % 3).cast("long")).alias("patches"))
    p = parts(spark, sf_dir).withColumn("images", F.array(medium))
    text = lambda name, **t: Z.media_text(F.lit("a<image>b"), "image", F.col("images"), Z.plugin(name, **t))
    return p.select("p_partkey", text("qwen2_vl").alias("grid"), text("intern_vl", image_length=16).alias("tiles"), text("pixtral", patch=14).alias("rows"), text("llava").alias("patches"), text("ernie_vl").alias("numbered"))


QWEN = ("", "<|im_start|>system\\n{{content}}<|im_end|>\\n", "<|im_start|>user\\n{{content}}<|im_end|>\\n<|im_start|>assistant\\n", "{{content}}<|im_end|>\\n")
LLAMA3 = ("<|begin_of_text|>", "<|start_header_id|>system<|end_header_id|>\\n\\n{{content}}<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\\n\\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\\n\\n", "{{content}}<|eot_id|>")
MISTRAL = ("<s>", "{{content}}\\n\\n", "[INST] {{content}}[/INST] ", "{{content}}</s>")


@query(
    "inferred_templates",
    " UNION ALL ".join("SELECT '" + name + "' AS model, " + ", ".join(f"'{v}' AS \"{c}\"" for c, v in zip(("prefix", "system", "user", "assistant"), slots, strict=True)) + f", {str(inside).lower()} AS system_in_first_user" for name, slots, inside in (("qwen", QWEN, False), ("llama3", LLAMA3, False), ("mistral", MISTRAL, True))).replace("\\n", "' || chr(10) || '"),
)
def _inferred(spark, sf_dir):
    """The slots of three chat formats from what all conversations look like in them."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text <> ''")
    talks = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("all"))
    bare = F.filter("all", lambda x: x["role"] != "system")
    system = F.get(F.filter("all", lambda x: x["role"] == "system"), F.lit(0))["content"]
    talks = talks.select(bare.alias("m"), system.alias("s")).where(F.size("m") > 1)
    own = F.when(F.col("s").isNotNull(), F.concat(F.array(F.struct(F.lit("system").alias("role"), F.col("s").alias("content"))), F.col("m"))).otherwise(F.col("m"))
    made = []
    for name, begin, end in (("qwen", "", "<|im_end|>"), ("llama3", "<|begin_of_text|>", "<|eot_id|>"), ("mistral", "<s>", "</s>")):
        text = F.array_join(M.render("m", M.resolve(name), "s", end, begin), "")
        made.append(talks.select(F.lit(name).alias("model"), own.alias("messages"), text.alias("text")))
    rows = made[0].unionByName(made[1]).unionByName(made[2])
    return N.infer_templates(rows, "model", "messages", "text").select("model", "prefix", "system", "user", "assistant", "system_in_first_user")
