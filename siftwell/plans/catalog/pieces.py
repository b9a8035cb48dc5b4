"""Queries of single operators over the tables: sizes, frames, positions, rewards, packing, tools and message lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import points as P
from siftwell.functions import templates as M
from siftwell.functions import tools as K
from siftwell.functions import vector as V
from siftwell.operators import convert as C
from siftwell.operators import geometry as Q
from siftwell.operators import groupstats as G
from siftwell.operators import labels as L
from siftwell.operators import media as A
from siftwell.operators import metrics as X
from siftwell.operators import mix
from siftwell.operators import scoring as S
from siftwell.operators import tokens as T
from siftwell.plans.catalog.convert import PAIRS, pairs
from siftwell.plans.catalog.groupstats import SEQ, sequences
from siftwell.plans.catalog.tokens import shown
from siftwell.plans.registry import query


def r6(c):
    return F.round(c, 6)


def parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# ---- sizes, frames and vectors ------------------------------------------------------------


@query("ceil_divisions", "SELECT p_partkey, CAST(ceil(p_size / 7.0) AS BIGINT) AS n FROM part")
def _ceil(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", V.ceil_div(F.col("p_size"), F.lit(7)).cast("long").alias("n"))


@query("unit_vectors", "SELECT p_partkey, round(p_size / sqrt(p_size * p_size + (p_partkey % 5) * (p_partkey % 5) + 4), 6) AS x, round(2 / sqrt(p_size * p_size + (p_partkey % 5) * (p_partkey % 5) + 4), 6) AS z FROM part")
def _unit(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("u", V.unit(F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 5).cast("double"), F.lit(2.0))))
    return p.select("p_partkey", r6(F.col("u")[0]).alias("x"), r6(F.col("u")[2]).alias("z"))


@query("rounded_vectors", "SELECT p_partkey, round(p_retailprice / 7, 2) AS x, round(p_size / 3.0, 2) AS y FROM part")
def _rounded(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("r", V.rounded(F.array(F.col("p_retailprice") / 7, F.col("p_size") / 3), 2))
    return p.select("p_partkey", F.col("r")[0].alias("x"), F.col("r")[1].alias("y"))


@query("normal_colours", "SELECT p_partkey, CAST(trunc((p_size / 50.0 + 1) * 127.5) AS INTEGER) AS red, CAST(trunc((1 - p_size / 50.0) * 127.5) AS INTEGER) AS green FROM part")
def _normals(spark, sf_dir):
    n = V.normal_colour(F.array(F.col("p_size") / 50.0, -F.col("p_size") / 50.0))
    return parts(spark, sf_dir).select("p_partkey", n[0].alias("red"), n[1].alias("green"))


@query(
    "pixel_bounds",
    """WITH a AS (SELECT p_partkey, p_size * 40 + 3 AS w, CAST(trunc(p_retailprice) AS BIGINT) AS h FROM part),
b AS (SELECT p_partkey, CASE WHEN w * h > 500000 THEN CAST(trunc(w * sqrt(500000.0 / (w * h))) AS BIGINT) ELSE w END AS w, CASE WHEN w * h > 500000 THEN CAST(trunc(h * sqrt(500000.0 / (w * h))) AS BIGINT) ELSE h END AS h FROM a)
SELECT p_partkey, CAST(CASE WHEN w * h < 200000 THEN CAST(trunc(w * sqrt(200000.0 / (w * h))) AS BIGINT) ELSE w END AS BIGINT) AS width, CAST(CASE WHEN w * h < 200000 THEN CAST(trunc(h * sqrt(200000.0 / (w * h))) AS BIGINT) ELSE h END AS BIGINT) AS height FROM b""",
)
def _bounds(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("b", V.pixel_bounds(F.col("p_size") * 40 + 3, F.col("p_retailprice").cast("long"), 200000, 500000))
    return p.select("p_partkey", F.col("b.width").cast("long").alias("width"), F.col("b.height").cast("long").alias("height"))


@query(
    "target_sizes",
    """WITH a AS (SELECT p_partkey, p_size * 40.0 + 3 AS w, trunc(p_retailprice) AS h FROM part),
b AS (SELECT *, (greatest(round_even(w / 28, 0) * 28, 28) / w + greatest(round_even(h / 28, 0) * 28, 28) / h) / 2 AS s FROM a)
SELECT p_partkey, CAST(greatest(round_even(w * s / 28, 0) * 28, 28) AS BIGINT) AS width, CAST(greatest(round_even(h * s / 28, 0) * 28, 28) AS BIGINT) AS height FROM b""",
)
def _targets(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("t", A.target_size(F.col("p_size") * 40.0 + 3, F.col("p_retailprice").cast("long").cast("double"), 28))
    return p.select("p_partkey", "t.width", "t.height")


@query(
    "pixel_points",
    "SELECT p_partkey, CAST(round_even(p_size * 20 / 1000.0 * 639, 0) AS INTEGER) AS x, CAST(greatest(0, least(479, round_even((p_partkey % 1200) / 1000.0 * 479, 0))) AS INTEGER) AS y FROM part",
)
def _pixels(spark, sf_dir):
    q = P.to_pixel(F.array(F.col("p_size") * 20, F.col("p_partkey") % 1200), F.lit(640), F.lit(480))
    return parts(spark, sf_dir).select("p_partkey", q[0].alias("x"), q[1].alias("y"))


@query("points_in_boxes", "SELECT p_partkey, CAST((CASE WHEN p_size BETWEEN 10 AND 30 THEN 1 ELSE 0 END) + (CASE WHEN p_size * 2 BETWEEN 10 AND 30 THEN 1 ELSE 0 END) AS INTEGER) AS inside, 2 AS total FROM part")
def _in_box(spark, sf_dir):
    ps = F.array(F.array(F.col("p_size") + 0.25, F.lit(5.0)), F.array(F.col("p_size") * 2 - 0.25, F.lit(7.0)))
    c = P.count_in_box(ps, F.array(F.lit(10), F.lit(0), F.lit(30), F.lit(9)))
    return parts(spark, sf_dir).withColumn("c", c).select("p_partkey", "c.inside", "c.total")


@query(
    "points_in_masks",
    "SELECT p_partkey, CAST((p_size % 8 < 4)::INTEGER + (p_partkey % 10 < 4)::INTEGER AS INTEGER) AS inside, 3 AS total, CAST(greatest((p_size % 8 < 4)::INTEGER, (p_partkey % 10 < 4)::INTEGER) AS INTEGER) AS covered FROM part",
)
def _in_mask(spark, sf_dir):
    """A mask of eight by three whose left half counts; the third point lies outside."""
    mask = F.unhex(F.lit("0101010100000000" * 3))
    ps = F.array(F.array((F.col("p_size") % 8).cast("double"), F.lit(1.0)), F.array((F.col("p_partkey") % 10).cast("double"), F.lit(2.0)), F.array(F.lit(1.0), F.lit(9.0)))
    p = parts(spark, sf_dir).withColumn("c", P.count_in_mask(ps, mask, F.lit(8))).withColumn("m", P.masks_covered(ps, F.array(mask), F.lit(8)))
    return p.select("p_partkey", "c.inside", "c.total", "m.covered")


@query(
    "frame_counts",
    """WITH n AS (SELECT p_partkey, p_size * 100 + 100 AS t FROM part)
SELECT p_partkey, CAST(floor(least(greatest(t / 25.0 * 2.0, 4), floor(least(768, t) / 2) * 2, t) / 2) * 2 AS BIGINT) AS frames FROM n""",
)
def _frame_counts(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", A.frame_count(F.col("p_size") * 100 + 100, F.lit(25.0)).alias("frames"))


@query("even_frames", "SELECT p_partkey, array_to_string([CAST(round_even(p_size + i * (p_size * 10) / 6.0, 0) AS BIGINT) FOR i IN range(7)], ',') AS frames FROM part")
def _evenly(spark, sf_dir):
    e = A.evenly(F.col("p_size"), F.col("p_size") * 11, F.lit(7))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(e.cast("array<string>"), ",").alias("frames"))


@query(
    "rope_positions",
    """WITH p AS (SELECT p_partkey, 1 + p_size % 3 AS h, 2 + p_partkey % 3 AS w, p_size % 4 AS a FROM part), i AS (SELECT *, unnest(range(a + h * w + 2)) AS i FROM p)
SELECT p_partkey, string_agg(CASE WHEN i < a THEN i || ':' || i || ':' || i WHEN i < a + h * w THEN a || ':' || (a + (i - a) // w) || ':' || (a + (i - a) % w)
 ELSE (a + greatest(h, w) + i - a - h * w) || ':' || (a + greatest(h, w) + i - a - h * w) || ':' || (a + greatest(h, w) + i - a - h * w) END, ' ' ORDER BY i) AS positions FROM i GROUP BY p_partkey""",
)
def _rope(spark, sf_dir):
    """Some text, one image, two tokens of text."""
    p = parts(spark, sf_dir).withColumn("h", 1 + F.col("p_size") % 3).withColumn("w", 2 + F.col("p_partkey") % 3)
    kinds = F.concat(F.array_repeat(F.lit(0), (F.col("p_size") % 4).cast("int")), F.array_repeat(F.lit(1), (F.col("h") * F.col("w")).cast("int")), F.array(F.lit(0), F.lit(0)))
    p = p.withColumn("kinds", kinds).withColumn("grids", F.array(F.array(F.lit(1).cast("long"), F.col("h").cast("long"), F.col("w").cast("long")))).withColumn("r", A.rope_positions("kinds", "grids"))
    return p.select("p_partkey", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["t"].cast("string"), x["h"].cast("string"), x["w"].cast("string"))), " ").alias("positions"))


@query(
    "timed_videos",
    "SELECT p_partkey, 'see ' || string_agg('<' || CAST(i // 2 AS VARCHAR) || CASE WHEN i % 2 = 0 THEN '.0' ELSE '.5' END || ' seconds><|vision_start|>' || repeat('<|video_pad|>', CAST(p_size AS INTEGER)) || '<|vision_end|>', '' ORDER BY i) || ' end' AS text FROM part, range(3) r(i) GROUP BY p_partkey",
)
def _timed(spark, sf_dir):
    text = A.timed_video(F.lit("see <video> end"), F.array(F.lit(3), F.lit(2), F.col("p_size") * 2), F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    return parts(spark, sf_dir).select("p_partkey", text.alias("text"))


@query("placeholder_parts", "SELECT item_id, CAST(len(string_split(text, '. ')) - 1 AS INTEGER) AS media, array_to_string([x FOR x IN string_split(text, '. ') IF x <> ''], '|') AS texts FROM benchmark")
def _placeholder_parts(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("c", A.split_placeholders(F.col("text"), r"\. ", "image"))
    return b.select("item_id", F.size(F.filter("c", lambda x: x["type"] == "image")).alias("media"), F.array_join(F.transform(F.filter("c", lambda x: x["type"] == "text"), lambda x: x["value"]), "|").alias("texts"))


@query(
    "media_messages",
    "SELECT item_id, 'a' || item_id || ',b' AS images, 'v' AS videos, CAST(3 AS INTEGER) AS items, 'image image video text' AS kinds FROM benchmark",
)
def _media_messages(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    content = A.ordered_content(F.array(F.concat(F.lit("a"), F.col("item_id").cast("string")), F.lit("b")), F.array(F.lit("v")), F.col("text"))
    b = b.withColumn("m", F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))).withColumn("s", A.split_media("m"))
    return b.select("item_id", F.array_join("s.images", ",").alias("images"), F.array_join("s.videos", ",").alias("videos"), F.size(A.media_items("m")).alias("items"), F.array_join(F.transform(F.col("m")[0]["content"], lambda c: c["type"]), " ").alias("kinds"))


@query(
    "question_texts",
    """SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN chr(10) || 'Options:' || chr(10) || 'A' || chr(10) || 'B' || chr(10) || chr(10) || 'Please provide only the single option letter (e.g., A, B, C, D, etc.) within the <answer> </answer> tags.'
 WHEN 1 THEN chr(10) || 'Please provide the numerical value within the <answer> </answer> tags.' ELSE '' END AS question FROM benchmark""",
)
def _questions(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("multiple choice"), F.lit("numerical"), F.lit("other")), (F.col("item_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", A.question_text(F.col("text"), kind, F.array(F.lit("A"), F.lit("B"))).alias("question"))


# ---- rewards and metrics ------------------------------------------------------------------


@query("placed_scores", SEQ + ", l AS (SELECT user_id, day, max(pos) FILTER (m = 1) AS last, count(*) AS n FROM s GROUP BY user_id, day) SELECT event_id, CAST(CASE WHEN pos = last THEN n ELSE 0 END AS DOUBLE) AS reward FROM s JOIN l USING (user_id, day)")
def _placed(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("n", F.size("m")).withColumn("x", G.place_score("n", "m"))
    return df.select(F.explode(F.arrays_zip("ids", "x")).alias("z")).select(F.col("z.ids").alias("event_id"), F.col("z.x").alias("reward"))


@query("last_counted_values", SEQ + "SELECT user_id, day, arg_max(v, pos) FILTER (m = 1) AS value FROM s GROUP BY user_id, day")
def _last(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", "day", G.last_counted("v", "m").alias("value"))


@query("running_baselines", SEQ + "SELECT event_id, round(coalesce(avg(v) OVER (PARTITION BY user_id, day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS baseline FROM s")
def _running(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("x", G.running_baseline("v"))
    return df.select(F.explode(F.arrays_zip("ids", "x")).alias("z")).select(F.col("z.ids").alias("event_id"), r6(F.col("z.x")).alias("baseline"))


@query(
    "moving_baseline_losses",
    "WITH p AS (SELECT event_id, value / 10 AS c, (event_id % 17) / 5.0 AS r, (event_id % 7) / 9.0 AS b FROM events) SELECT event_id, round(ln(1 + exp(-(0.1 * c - b))) + ln(1 + exp(-(b - 0.1 * r))), 6) AS loss FROM p",
)
def _moving(spark, sf_dir):
    i = F.col("event_id")
    return events(spark, sf_dir).select("event_id", r6(G.moving_baseline_loss(F.col("value") / 10, (i % 17) / 5.0, (i % 7) / 9.0)).alias("loss"))


@query("nan_skipping_sums", "SELECT event_type, round(coalesce(sum(value) FILTER (event_id % 4 <> 0), 0), 4) AS total, count(*) FILTER (event_id % 4 <> 0) AS n FROM events GROUP BY event_type")
def _nans(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return G.nan_skipping(e, "event_type", ["x"]).select("event_type", F.round("x_sum", 4).alias("total"), F.col("x_count").alias("n"))


@query(
    "discounted_logps",
    SEQ
    + """, n AS (SELECT *, lead(CASE WHEN m = 0 THEN -100 ELSE 1 END) OVER (PARTITION BY user_id, day ORDER BY event_id) AS label FROM s),
f AS (SELECT *, min(pos) FILTER (label <> -100) OVER (PARTITION BY user_id, day) AS first FROM n)
SELECT user_id, day, round(coalesce(sum(o * CASE WHEN pos - 1 < first - 1 + 2 THEN 1 ELSE 0.25 END) FILTER (label IS NOT NULL AND label <> -100), 0), 6) AS logps, CAST(count(*) FILTER (label IS NOT NULL AND label <> -100) AS INTEGER) AS counted FROM f GROUP BY user_id, day""",
)
def _discounted_logps(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("labels", F.transform("m", lambda m: F.when(m == 0, -100).otherwise(1)))
    return df.select("user_id", "day", r6(G.discounted_logps("o", "labels", F.lit(2), 0.25)).alias("logps"), G.counted_labels("labels").alias("counted"))


@query("step_timings", "SELECT event_id, round(value * 1000 / (event_id % 9 + 1), 6) AS per_token, round((event_id % 9 + 1) / ((value + 1) * 8), 6) AS throughput, round(value / (event_id % 9 + 1) * (20 - (event_id % 9 + 1)), 6) AS remaining FROM events")
def _timings(spark, sf_dir):
    n = F.col("event_id") % 9 + 1
    return events(spark, sf_dir).select("event_id", r6(X.timing_per_token(F.col("value"), n)).alias("per_token"), r6(X.throughput(n, F.col("value") + 1, 8)).alias("throughput"), r6(X.remaining_time(n, F.lit(20), F.col("value"))).alias("remaining"))


@query("label_ratio", SEQ + "SELECT round(sum(m) / count(*), 6) AS ratio FROM s")
def _ratio(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("labels", F.transform("m", lambda m: F.when(m == 0, -100).otherwise(1)))
    return X.label_ratio(df, "labels").withColumn("ratio", r6(F.col("ratio")))


@query(
    "token_accuracy",
    SEQ
    + """, n AS (SELECT user_id, day, event_id % 3 AS p, lead(CASE WHEN m = 0 THEN -100 ELSE event_id % 2 END) OVER (PARTITION BY user_id, day ORDER BY event_id) AS l FROM s),
r AS (SELECT avg(CASE WHEN p = l THEN 1.0 ELSE 0.0 END) AS a FROM n WHERE l IS NOT NULL AND l <> -100 GROUP BY user_id, day) SELECT round(avg(a), 6) AS accuracy FROM r""",
)
def _accuracy(spark, sf_dir):
    df = sequences(spark, sf_dir).withColumn("p", F.transform("ids", lambda i: i % 3)).withColumn("l", F.transform(F.arrays_zip("ids", "m"), lambda z: F.when(z["m"] == 0, -100).otherwise(z["ids"] % 2)))
    return X.token_accuracy(df, "p", "l").withColumn("accuracy", r6(F.col("accuracy")))


@query("user_scored_batches", "SELECT event_id, round(0.9 * (CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) + 0.1, 6) AS overall FROM events")
def _score_with(spark, sf_dir):
    def judge(pdf):
        right = (pdf["event_type"] == "click").astype(float)
        return pdf.assign(overall=0.9 * right + 0.1, format=1.0, accuracy=right)

    return S.score_with(events(spark, sf_dir).select("event_id", "event_type"), judge).select("event_id", r6(F.col("overall")).alias("overall"))


# ---- tokens and packing -------------------------------------------------------------------

@query(
    "multi_turn_encoding",
    """WITH RECURSIVE p AS (SELECT a.conv_id, hex(u.text) AS uh, hex(a.text) AS ah, strlen(u.text) AS s, strlen(a.text) AS t, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS k
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST(400 AS BIGINT) AS room, '' AS ids, '' AS labels FROM p
 UNION ALL SELECT conv_id, k, room - ks - kt, ids || substr(uh, 1, 2 * ks) || substr(ah, 1, 2 * kt), labels || repeat('--', ks) || substr(ah, 1, 2 * kt)
 FROM (SELECT *, least(greatest(room - kt, 0), s) AS ks FROM (SELECT *, least(CASE WHEN t * 2 < room THEN room WHEN s * 2 < room THEN room - s ELSE CAST(trunc(room * t / (s + t)) AS BIGINT) END, t) AS kt
  FROM (SELECT f.conv_id, p.k, f.room, f.ids, f.labels, p.uh, p.ah, p.s, p.t FROM f JOIN p ON p.conv_id = f.conv_id AND p.k = f.k + 1 WHERE f.room > 0))))
SELECT conv_id, arg_max(ids, k) AS ids, arg_max(labels, k) AS labels FROM f GROUP BY conv_id""",
)
def _multi(spark, sf_dir):
    p = pairs(spark, sf_dir).select("id.conv_id", "id.turn", T.byte_ids("instruction").alias("p"), T.byte_ids("output").alias("r"))
    c = p.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "p", "r"))).alias("s")).select("conv_id", F.col("s.p").alias("ps"), F.col("s.r").alias("rs"))
    return c.withColumn("e", T.multi_turn("ps", "rs", 400)).select("conv_id", shown("e.input_ids").alias("ids"), shown("e.labels").alias("labels"))


@query("rechunked_lists", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (k <= 1) AS first, CAST(greatest(count(*) - 1, 0) AS INTEGER) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) GROUP BY l_orderkey")
def _rechunk(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    x = x.select("l_orderkey", F.col("s.l_partkey").alias("p")).withColumn("n", F.array(F.lit(1), F.size("p") - 1)).withColumn("c", T.rechunk("p", "n"))
    return x.select("l_orderkey", F.array_join(F.col("c")[0].cast("array<string>"), ",").alias("first"), F.size(F.col("c")[1]).alias("rest"))


@query("stripped_responses", "SELECT conv_id, turn, CAST(greatest(strlen(text), 1) AS INTEGER) AS n FROM conversations")
def _strip(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("i", F.concat(T.byte_ids("text"), F.array_repeat(F.lit(-1), 5)))
    return c.select("conv_id", "turn", F.size(T.strip_response("i", -1)).alias("n"))


@query("tokenized_texts", "SELECT item_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n, CAST(length(string_split(text, ' ')[1]) AS INTEGER) AS first FROM benchmark")
def _tokenize(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    t = T.tokenize(b, "text", "ids", lambda texts: [[len(w) for w in x.split(" ")] for x in texts])
    return t.select("item_id", F.size("ids").alias("n"), F.col("ids")[0].alias("first"))


@query(
    "token_places",
    "WITH s AS (SELECT l_suppkey, l_partkey % 4 AS seg, row_number() OVER (ORDER BY l_suppkey, l_partkey % 4) - 1 AS i FROM lineitem) SELECT CAST(i AS BIGINT) AS index, CAST(row_number() OVER (ORDER BY i) - 1 AS BIGINT) AS place FROM s WHERE seg <> 0",
)
def _places(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.pmod("l_partkey", F.lit(4)).cast("int"))).alias("seg"))
    return T.token_places(rows, "l_suppkey", "seg")


@query(
    "cumulative_lengths",
    "WITH s AS (SELECT l_suppkey, l_partkey % 4 AS seg, count(*) AS n FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY ALL) SELECT CAST(n AS INTEGER) AS length, CAST(sum(n) OVER (ORDER BY l_suppkey, seg) AS BIGINT) AS end FROM s",
)
def _cumulative(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.pmod("l_partkey", F.lit(4)).cast("int"))).alias("seg"))
    return T.cumulative_lengths(rows, "l_suppkey", "seg")


# ---- messages, tools and templates --------------------------------------------------------


@query("openai_canonical", PAIRS + "SELECT conv_id, turn, q AS ask, '[{\"name\":\"f\",\"arguments\":\"{}\"}]' AS call, 'x' || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || 'y' AS seen, o AS answer, 'S' || chr(10) || 'detailed thinking off' AS system FROM p")
def _openai(spark, sf_dir):
    """A system text, a question, a call, two tool messages and the answer."""
    kind = "array<struct<function: struct<name: string, arguments: string>>>"
    none, call = F.lit(None).cast(kind), F.array(F.struct(F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments")).alias("function"))).cast(kind)
    m = lambda role, c, calls=none: F.struct(F.lit(role).alias("role"), c.alias("content"), calls.alias("tool_calls"))
    p = pairs(spark, sf_dir).withColumn("messages", F.array(m("system", F.lit("S")), m("user", F.col("instruction")), m("assistant", F.lit(""), call), m("tool", F.lit("x")), m("tool", F.lit("y")), m("assistant", F.col("output"))))
    c = C.openai(p, "id")
    return c.select("id.conv_id", "id.turn", F.expr("_prompt[0].content").alias("ask"), F.expr("_prompt[1].content").alias("call"), F.expr("_prompt[2].content").alias("seen"), F.expr("_response[0].content").alias("answer"), F.col("_system").alias("system"))


@query("pair_v1_messages", PAIRS + "SELECT conv_id, turn, 'user assistant' AS roles, o AS chosen, q AS rejected, CAST(1 AS DOUBLE) AS weight FROM p")
def _pair_v1(spark, sf_dir):
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    p = pairs(spark, sf_dir).withColumn("chosen", F.array(m("user", F.col("instruction")), m("robot", F.lit("?")), m("assistant", F.col("output")))).withColumn("rejected", F.array(m("user", F.col("output")), m("assistant", F.col("instruction"))))
    c = C.pair_v1(p, "id")
    return c.select("id.conv_id", "id.turn", F.array_join(F.transform("chosen_messages", lambda x: x["role"]), " ").alias("roles"), F.expr("chosen_messages[1].content[0].value").alias("chosen"), F.expr("rejected_messages[1].content[0].value").alias("rejected"), F.expr("rejected_messages[1].loss_weight").alias("weight"))


@query("valid_rankings", PAIRS + "SELECT conv_id, turn FROM p")
def _rankings(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("chosen", F.col("output")).withColumn("rejected", F.col("instruction"))
    return C.valid_pairwise(C.alpaca(p, "id", kind="ranking")).select("id.conv_id", "id.turn")


@query("valid_prompts", PAIRS + "SELECT conv_id, turn FROM p")
def _prompts(spark, sf_dir):
    return C.valid_unsupervised(C.alpaca(pairs(spark, sf_dir), "id")).select("id.conv_id", "id.turn")


@query(
    "few_shot_messages",
    """SELECT item_id, 'The following are multiple choice questions (with answers) about lists.' || chr(10) || chr(10) || 'S0' || chr(10) || 'A. a' || chr(10) || 'B. b' || chr(10) || 'Answer:' AS first, 'S1' || chr(10) || 'A. a' || chr(10) || 'B. b' || chr(10) || 'Answer:' AS second,
 text || chr(10) || 'A. x' || chr(10) || 'Answer:' AS own, 'A' AS answer, CAST(6 AS INTEGER) AS n FROM benchmark""",
)
def _few_shot(spark, sf_dir):
    support = spark.range(2).select(F.col("id").alias("shot"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("question"), F.lit("a").alias("A"), F.lit("b").alias("B"), F.lit(None).cast("string").alias("C"), F.lit(None).cast("string").alias("D"), F.lit("B").alias("answer"))
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("question"), F.lit("x").alias("A"), *(F.lit(None).cast("string").alias(c) for c in "BCD"), F.lit("A").alias("answer"))
    m = C.few_shot(rows, support, "item_id", "lists")
    return m.select("item_id", F.expr("messages[0].content").alias("first"), F.expr("messages[2].content").alias("second"), F.expr("messages[4].content").alias("own"), F.expr("messages[5].content").alias("answer"), F.size("messages").alias("n"))


@query("tool_calls_by_format", "SELECT event_id, f.fmt, CASE WHEN fmt <> 'glm4_moe' THEN event_type END AS name, CASE WHEN fmt <> 'glm4_moe' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events, (VALUES ('default'), ('glm4'), ('glm4_moe'), ('ling'), ('llama3'), ('mistral'), ('qwen'), ('seed_oss')) f(fmt)")
def _tool_calls(spark, sf_dir):
    """Each event as a call, written and read back in every format; what glm4_moe writes is no call to its reader."""
    e = events(spark, sf_dir).select("event_id", F.format_string('{"name": "%s", "arguments": %s}', "event_type", "props").alias("call"))
    out = []
    for fmt in sorted(K.FORMATS):
        rows = K.with_calls(K.with_written_calls(e, "call", "text", fmt), "text", fmt)
        out.append(rows.select("event_id", F.lit(fmt).alias("fmt"), F.col("calls")[0]["name"].alias("name"), F.get_json_object(F.col("calls")[0]["arguments"], "$.k").cast("int").alias("k")))
    return mix.union_all(out)


@query(
    "tool_descriptions",
    """SELECT n_name, chr(10) || chr(10) || '# Tools' || chr(10) || chr(10) || 'You may call one or more functions to assist with the user query.' || chr(10) || chr(10) || 'You are provided with function signatures within <tools></tools> XML tags:' || chr(10) || '<tools>' || chr(10)
 || '{"type": "function", "function": {"name": "' || n_name || '", "parameters": {"k": 1}}}' || chr(10) || '</tools>' || chr(10) || chr(10) || 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:' || chr(10) || '<tool_call>' || chr(10)
 || '{"name": <function-name>, "arguments": <args-json-object>}' || chr(10) || '</tool_call>' AS text FROM nation""",
)
def _descriptions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", F.format_string('[{"name": "%s", "parameters": {"k": 1}}]', "n_name").alias("tools"))
    return K.with_descriptions(n, "tools", "text", "qwen").select("n_name", "text")


@query(
    "training_pairs",
    PAIRS + "SELECT conv_id, turn, 'Human: ' || q || '</s>' || chr(10) || 'Assistant:' AS prompt, o || '</s>' || chr(10) AS response, CAST(1 AS INTEGER) AS pairs FROM p",
)
def _training(spark, sf_dir):
    m = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    p = pairs(spark, sf_dir).withColumn("m", F.array(m("user", "instruction"), m("assistant", "output"))).withColumn("t", M.render("m", M.resolve("default"), end_token="</s>"))
    p = p.withColumn("e", M.prompt_and_response("t")).withColumn("all", M.turn_pairs("t"))
    return p.select("id.conv_id", "id.turn", "e.prompt", "e.response", F.size("all").alias("pairs"))


# ---- labels and points --------------------------------------------------------------------


@query("vocabulary_json", "SELECT '[' || string_agg('{\"label\":\"' || event_type || '\",\"support\":' || n || '}', ',' ORDER BY n DESC, event_type) || ']' AS labels FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _vocabulary(spark, sf_dir):
    return L.vocabulary_json(events(spark, sf_dir).groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("support")))


@query("mapped_labels", "SELECT 'land ' || n_nationkey AS label, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'land' END AS canonical FROM nation")
def _mapped(spark, sf_dir):
    """A reply that maps every nation, read back."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("land "), F.col("n_nationkey").cast("string")).alias("label"), "n_nationkey")
    pairs_ = F.array_sort(F.collect_list(F.struct("label", F.when(F.col("n_nationkey") % 3 == 0, "drop").otherwise("land").alias("to"))))
    reply = n.agg(F.concat(F.lit("Here: "), F.to_json(F.map_from_entries(pairs_))).alias("reply"))
    return L.mapping_from_reply(reply, "reply", n.select("label"))


@query("instance_annotations", "SELECT l_orderkey, string_agg(k || ':' || l_partkey || ':' || CAST(trunc(l_quantity) AS INTEGER), ' ' ORDER BY k) AS found FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem) GROUP BY l_orderkey")
def _annotations(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("s"))
    x = x.select("l_orderkey", F.col("s.l_partkey").alias("names"), F.col("s.l_quantity").alias("areas")).withColumn("boxes", F.transform("areas", lambda a: F.array(a, a))).withColumn("scores", F.col("areas"))
    a = x.withColumn("a", L.annotations("names", "boxes", "areas", "scores"))
    return a.select("l_orderkey", F.array_join(F.transform("a", lambda z: F.concat_ws(":", z["instance_id"].cast("string"), z["class_name"].cast("string"), z["mask_area"].cast("int").cast("string"))), " ").alias("found"))


@query(
    "instance_colours",
    """WITH r AS (SELECT l_suppkey AS i, (row_number() OVER (ORDER BY l_suppkey) - 1) * 6.0 / count(*) OVER () AS h FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey <> 0)),
c AS (SELECT i, CAST(floor(h) AS INTEGER) AS s, h - floor(h) AS f FROM r)
SELECT i AS l_suppkey, CAST(trunc(255 * CASE s WHEN 0 THEN 1 WHEN 1 THEN 1 - f WHEN 4 THEN f WHEN 5 THEN 1 ELSE 0 END) AS INTEGER) AS red, CAST(trunc(255 * CASE s WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - f ELSE 0 END) AS INTEGER) AS green, CAST(trunc(255 * CASE s WHEN 2 THEN f WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 - f ELSE 0 END) AS INTEGER) AS blue FROM c""",
)
def _colours(spark, sf_dir):
    return Q.instance_colours(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey"), "l_suppkey")
