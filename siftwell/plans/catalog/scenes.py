"""Queries of label cleaning, geometry and vectors over parts, line items and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions import vector as V
from siftwell.operators import geometry as G
from siftwell.operators import labels as L
from siftwell.plans.registry import query


def r6(c):
    return F.round(c, 6)


def tags(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("text", F.concat_ws(",", F.translate("p_name", " ", ","), "p_type", F.lit("Boxes; glass / BUS")))
    return L.tags_from_text(p, "p_brand", "text")


TAGS = """WITH raw AS (SELECT p_brand AS image, unnest(string_split(replace(p_name, ' ', ',') || ',' || p_type || ',boxe,glass,bus', ',')) AS w FROM part),
n AS (SELECT image, trim(lower(w)) AS w FROM raw), t AS (SELECT DISTINCT image, CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS label FROM n)
"""


@query("image_tags", TAGS + "SELECT image, label FROM t")
def _tags(spark, sf_dir):
    return tags(spark, sf_dir)


@query("tag_prompts", TAGS + "SELECT image, string_agg(label, '. ' ORDER BY label) AS prompt FROM t GROUP BY image")
def _prompts(spark, sf_dir):
    return L.tag_lists(tags(spark, sf_dir)).select("image", "prompt")


CLASSES = TAGS + ", s AS (SELECT label, count(*) AS support FROM t GROUP BY label), c AS (SELECT label, support, CAST(row_number() OVER (ORDER BY support DESC, label) AS INTEGER) AS class_id FROM s)\n"


@query("class_table", CLASSES + "SELECT label, support, class_id FROM c")
def _classes(spark, sf_dir):
    return L.class_table(tags(spark, sf_dir))


@query("support_from_rows", "SELECT lower(p_type) AS label, CAST(max(p_size) AS INTEGER) AS support FROM (SELECT CASE WHEN p_type LIKE '%S' AND p_type NOT LIKE '%SS' THEN left(p_type, length(p_type) - 1) ELSE p_type END AS p_type, p_size FROM part) GROUP BY 1")
def _support_rows(spark, sf_dir):
    return L.support_from_rows(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_type", "p_size")


def mapping(spark):
    return spark.createDataFrame([("ring", "band"), ("widget", "gadget"), ("economy", None), ("gear", "gadget")], "label string, canonical string")


MAPPED = TAGS + ", m(label, canonical) AS (VALUES ('ring', 'band'), ('widget', 'gadget'), ('economy', NULL), ('gear', 'gadget')), a AS (SELECT DISTINCT image, CASE WHEN m.label IS NULL THEN t.label ELSE m.canonical END AS label FROM t LEFT JOIN m ON m.label = t.label)\n"


@query("apply_mapping", MAPPED + "SELECT image, string_agg(label, ',' ORDER BY label) AS labels FROM a WHERE label IS NOT NULL GROUP BY image")
def _mapping(spark, sf_dir):
    return L.apply_mapping(tags(spark, sf_dir), mapping(spark)).select("image", F.array_join("labels", ",").alias("labels"))


@query("clean_report", MAPPED + ", o AS (SELECT DISTINCT t.label, CASE WHEN m.label IS NULL THEN t.label ELSE m.canonical END AS c FROM t LEFT JOIN m ON m.label = t.label) SELECT count(*) AS labels, count(*) FILTER (c IS NULL) AS dropped, count(DISTINCT c) AS canonical_labels, (SELECT count(*) FROM (SELECT c FROM o WHERE c IS NOT NULL GROUP BY c HAVING count(*) > 1)) AS groups FROM o")
def _clean(spark, sf_dir):
    return L.clean_report(tags(spark, sf_dir), mapping(spark))


@query("class_names", CLASSES + "SELECT p_partkey, coalesce(c.label, 'class_' || CAST(p_size AS VARCHAR)) AS class_name FROM part LEFT JOIN c ON c.class_id = p_size")
def _names(spark, sf_dir):
    return L.lookup_names(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), L.class_table(tags(spark, sf_dir)), "p_size").select("p_partkey", "class_name")


@query("packed_instances", CLASSES + "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS instance_id, CAST(class_id * 65536 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS packed, class_id FROM part JOIN c ON c.label = lower(p_type)")
def _packed(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.lower("p_type").alias("label"))
    rows = L.number_instances(m, L.class_table(tags(spark, sf_dir)), "p_brand", "p_partkey", "label").drop("class_id", "instance_id")
    c, i = L.unpack("packed")
    return rows.select("p_partkey", i.alias("instance_id"), "packed", c.alias("class_id"))


def points(spark, sf_dir):
    """Line items as points: image = linenumber, instance = supplier, class = 1 + part modulo 5."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select(F.col("l_linenumber").alias("image_id"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("point_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100 + F.col("l_tax")).alias("z"), F.col("l_suppkey").cast("int").alias("instance_id"), (F.col("l_partkey") % 5 + 1).cast("int").alias("class_id"))


PTS = "WITH p AS (SELECT l_linenumber AS image_id, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 AS point_id, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 + l_tax AS z, CAST(l_suppkey AS INTEGER) AS instance_id, CAST(l_partkey % 5 + 1 AS INTEGER) AS class_id FROM lineitem) "


@query("voxel_centres", PTS + "SELECT image_id, CAST(floor(x / 7.3) AS BIGINT) AS vx, CAST(floor(y / 7.3) AS BIGINT) AS vy, CAST(floor(z / 7.3) AS BIGINT) AS vz, count(*) AS n, round(avg(x), 10) AS x, round(avg(y), 10) AS y, round(avg(z), 10) AS z FROM p GROUP BY 1, 2, 3, 4")
def _voxels(spark, sf_dir):
    v = G.voxels(points(spark, sf_dir), 7.3)
    return v.select("image_id", "vx", "vy", "vz", "n", *(F.round(a, 10).alias(a) for a in "xyz"))


@query("instance_boxes", PTS + "SELECT instance_id, class_id, count(*) AS num_points, round(avg(x), 10) AS mean_x, round(avg(y), 10) AS mean_y, round(avg(z), 10) AS mean_z, round(min(x), 10) AS min_x, round(min(y), 10) AS min_y, round(min(z), 10) AS min_z, round(max(x), 10) AS max_x, round(max(y), 10) AS max_y, round(max(z), 10) AS max_z, round(max(x) - min(x), 10) AS length_x, round(max(y) - min(y), 10) AS length_y, round(max(z) - min(z), 10) AS length_z FROM p GROUP BY 1, 2")
def _boxes(spark, sf_dir):
    return G.boxes(points(spark, sf_dir), ["instance_id", "class_id"], 10)


@query("room_extents", PTS + "SELECT image_id, round(max(x) - min(x), 6) AS extent_x, round(max(y) - min(y), 6) AS extent_y, round((max(x) - min(x)) * (max(y) - min(y)), 4) AS area, round(avg(z), 6) AS mean_z FROM p GROUP BY 1")
def _extents(spark, sf_dir):
    e = G.extents(points(spark, sf_dir), ["image_id"])
    return e.select("image_id", r6(F.col("extent_x")).alias("extent_x"), r6(F.col("extent_y")).alias("extent_y"), F.round("area", 4).alias("area"), r6(F.col("mean_z")).alias("mean_z"))


@query("object_counts", PTS + ", d AS (SELECT DISTINCT image_id, instance_id, class_id FROM p) SELECT image_id, 'class_' || CAST(class_id AS VARCHAR) AS name, CAST(count(*) AS INTEGER) AS n FROM d GROUP BY 1, 2")
def _counts(spark, sf_dir):
    i = points(spark, sf_dir).select("image_id", "instance_id", "class_id").distinct().withColumn("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return G.object_counts(i, "image_id", "name").select("image_id", F.explode("object_counts").alias("name", "n"))


@query(
    "plane_height",
    PTS + """, q AS (SELECT image_id, 0.36 * x + 0.48 * y + 0.8 * z AS p FROM p), s AS (SELECT image_id, min(p) AS lo, max(p) AS hi FROM q GROUP BY 1),
b AS (SELECT q.image_id, lo, hi, least(floor((p - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n FROM q JOIN s USING (image_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bin) AS k FROM b)
SELECT image_id, round(lo + (bin + 0.5) * (hi - lo) / 50, 6) AS height FROM r WHERE k = 1""",
)
def _plane(spark, sf_dir):
    return G.plane_height(points(spark, sf_dir), (0.36, 0.48, 0.8), ["image_id"], 50).select("image_id", r6(F.col("height")).alias("height"))


@query("world_points", PTS + "SELECT point_id, instance_id, round(0.8 * x - 0.6 * z + 1.5, 6) AS x, round(y - 2.0, 6) AS y, round(0.6 * x + 0.8 * z, 6) AS z FROM p")
def _world(spark, sf_dir):
    m = [[0.8, 0.0, -0.6, 1.5], [0.0, 1.0, 0.0, -2.0], [0.6, 0.0, 0.8, 0.0], [0.0, 0.0, 0.0, 1.0]]
    return G.transform(points(spark, sf_dir), m).select("point_id", "instance_id", *(r6(F.col(a)).alias(a) for a in "xyz"))


@query("backprojected_points", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity - 25.6) * l_discount / (0.9 * 50), 9) AS x, round((l_linenumber - 4.0) * l_discount / (1.1 * 8), 9) AS y, l_discount AS z FROM lineitem WHERE l_discount > 0")
def _backproject(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("u"), F.col("l_linenumber").alias("v"), F.col("l_discount").alias("depth"))
    p = G.backproject(x, 0.9, 1.1, 0.512, 0.5, 50, 8)
    return p.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "z")


@query("recoloured_points", PTS + "SELECT point_id, instance_id, CASE WHEN instance_id % 2 = 0 AND instance_id > 0 THEN 255 ELSE 77 END AS first FROM p")
def _recolour(spark, sf_dir):
    p = points(spark, sf_dir)
    c = p.where("instance_id > 0 AND instance_id % 2 = 0").select("instance_id").distinct().select("instance_id", *(F.lit(v).alias(n) for n, v in (("red", 255), ("green", 0), ("blue", 0))))
    return G.recolour(p, c, "instance_id").select("point_id", "instance_id", F.col("red").alias("first"))


@query("attached_boxes", "WITH b AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1) SELECT c_custkey AS o_custkey, score FROM customer LEFT JOIN b ON o_custkey = c_custkey")
def _attach(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"))
    b = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"), F.array("o_totalprice").alias("bbox"))
    return G.attach_boxes(c, b, ["o_custkey"], "o_orderkey").select("o_custkey", "score")


@query("complete_scenes", "SELECT c_custkey AS image_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events)")
def _complete(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("image_id"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("image_id"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("image_id"))
    return G.complete_scenes(c, [o, e])


@query("principal_boxes")
def _principal(spark, sf_dir):
    return G.principal_boxes(points(spark, sf_dir), ["instance_id"])


@query("dominant_normals")
def _normals(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = e.select(F.col("label").alias("image_id"), F.col("vec_id").alias("point_id"), *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("nx", "ny", "nz"))))
    return G.dominant_normal(p)


@query("scene_packages", PTS + "SELECT image_id, count(DISTINCT class_id) AS classes, '1.0' AS schema_version FROM p GROUP BY 1")
def _package(spark, sf_dir):
    p = points(spark, sf_dir)
    images = p.select("image_id").distinct()
    b = G.boxes(p, ["image_id", "class_id", "instance_id"]).withColumn("class_name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    counts = G.object_counts(b, "image_id", "class_name")
    doc = G.package(images, counts, G.extents(p, ["image_id"]), b)
    return doc.select("image_id", F.size("object_bboxes").cast("long").alias("classes"), "schema_version")


@query("normalized_vectors", "SELECT vec_id, round(list_extract(embedding, 1)::DOUBLE / (sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) + 1e-8), 6) AS first, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 6) AS norm FROM embeddings")
def _vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", r6(V.normalized(F.col("embedding"))[0]).alias("first"), r6(V.norm(F.col("embedding"))).alias("norm"))


@query(
    "box_overlap",
    """WITH b AS (SELECT l_orderkey AS k, l_partkey AS u, l_suppkey AS s, l_linenumber AS n, l_quantity AS x1, l_linenumber * 4.0 AS y1, l_quantity + l_discount * 300 AS x2, l_linenumber * 4.0 + l_tax * 300 AS y2 FROM lineitem),
i AS (SELECT *, greatest(least(x2, 40) - greatest(x1, 10), 0) * greatest(least(y2, 25) - greatest(y1, 5), 0) AS inside FROM b)
SELECT k, u, s, n, round(CASE WHEN x2 > x1 AND y2 > y1 THEN inside / ((x2 - x1) * (y2 - y1) + 600 - inside) ELSE 0 END, 6) AS iou FROM i""",
)
def _iou(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y = F.col("l_linenumber") * 4.0
    box = F.array(F.col("l_quantity"), y, F.col("l_quantity") + F.col("l_discount") * 300, y + F.col("l_tax") * 300)
    return x.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), r6(V.iou(box, F.array(*(F.lit(float(v)) for v in (10, 5, 40, 25))))).alias("iou"))


@query("smart_sizes", "WITH p AS (SELECT p_partkey, p_size * 40 + 3 AS h, CAST(trunc(p_retailprice) AS INTEGER) AS w FROM part) SELECT p_partkey, CAST(CASE WHEN hr * wr > 200000 THEN greatest(28, floor(h / sqrt(h * w / 200000.0) / 28) * 28) WHEN hr * wr < 100000 THEN ceil(h * sqrt(100000.0 / (h * w)) / 28) * 28 ELSE hr END AS BIGINT) AS height, CAST(CASE WHEN hr * wr > 200000 THEN greatest(28, floor(w / sqrt(h * w / 200000.0) / 28) * 28) WHEN hr * wr < 100000 THEN ceil(w * sqrt(100000.0 / (h * w)) / 28) * 28 ELSE wr END AS BIGINT) AS width FROM (SELECT *, greatest(28, round_even(h / 28, 0) * 28) AS hr, greatest(28, round_even(w / 28, 0) * 28) AS wr FROM p)")
def _sizes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("s", V.smart_size(F.col("p_size") * 40 + 3, F.col("p_retailprice").cast("int"), 28, 100000, 200000))
    return p.select("p_partkey", "s.height", "s.width")


@query("extracted_titles", "SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages")
def _titles(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = F.regexp_replace(F.regexp_replace("html", "<title>", "<answer>"), "</title>", "</answer>")
    return p.select("page_id", T.extract_answer(html).alias("title"))


@query("json_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", F.try_variant_get(T.lenient_json(fenced), "$.k", "int").alias("k"))


@query("json_candidates", "SELECT event_id, props AS found FROM events")
def _candidates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", T.json_candidate(F.concat(F.lit("so: "), F.col("props"), F.lit(" done"))).alias("found"))


@query("filled_templates", "SELECT event_id, '<s>Human: ' || event_type || chr(10) || 'Assistant:' AS text FROM events")
def _templates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.fill_template("<s>Human: {{content}}\nAssistant:", content=F.col("event_type")).alias("text"))


@query("data_uris", "SELECT p_partkey, 'data:image/png;base64,' || base64(encode(p_name)) AS uri FROM part")
def _uris(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.data_uri(F.encode("p_name", "UTF-8"), F.lit("a/b.PNG")).alias("uri"))


@query("pixel_products", "SELECT p_partkey, CAST(p_size * 32 AS BIGINT) AS pixels FROM part")
def _products(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.pixel_product(F.concat(F.col("p_size").cast("string"), F.lit("*32"))).alias("pixels"))


@query("cosine_schedule", "SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.1 + 0.9 * event_id / 100 ELSE greatest(0, cos((event_id - 100) / 900.0 * pi()) * 0.45 + 0.55) END, 6) AS lr FROM events")
def _cosine(spark, sf_dir):
    """Past the last step the wave goes on."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", r6(V.cosine_warmup(F.col("event_id"), 100, 1000, 0.1)).alias("lr"))
