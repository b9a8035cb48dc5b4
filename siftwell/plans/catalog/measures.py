"""Queries of exact quantiles, depth images, log probabilities from logits, addresses and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import addresses as A
from siftwell.operators import quantiles as Q
from siftwell.plans.registry import query


def r6(c):
    return F.round(c, 6)


def pixels(spark, sf_dir):
    """Prices as depths; nine tenths of all rows are one image, one in a hundred depths is not valid."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    image = F.when(F.col("l_orderkey") % 10 == 0, F.col("l_suppkey") % 5).otherwise(F.lit(99))
    depth = F.when(F.col("l_partkey") % 100 == 0, 0.0).otherwise(F.col("l_extendedprice"))
    return i.select(image.alias("image_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", depth.alias("depth"))


PIXELS = "WITH p AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN l_suppkey % 5 ELSE 99 END AS image_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 100 = 0 THEN 0 ELSE l_extendedprice END AS depth FROM lineitem), q AS (SELECT image_id, quantile_cont(depth, 0.02) AS lo, quantile_cont(depth, 0.98) AS hi FROM p WHERE depth > 0 GROUP BY 1)"


@query("depth_ranges", PIXELS + " SELECT image_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM q")
def _ranges(spark, sf_dir):
    return Q.depth_range(pixels(spark, sf_dir)).select("image_id", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query(
    "depth_shades",
    PIXELS + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN depth > 0 THEN floor((1 - greatest(least((depth - lo) / (hi - lo + 1e-8), 1), 0)) * 255) ELSE 0 END AS INTEGER) AS shade FROM p JOIN q USING (image_id)",
)
def _shades(spark, sf_dir):
    return Q.depth_shades(pixels(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "shade")


@query("exact_quantiles", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.999), 6) AS q999 FROM events GROUP BY 1")
def _quantiles(spark, sf_dir):
    q = Q.exact_quantiles(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "value", (0.1, 0.5, 0.999))
    return q.select("event_type", "n", *(r6(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q999"))))


@query(
    "logits_to_logps",
    """WITH v AS (SELECT l_orderkey, (l_linenumber - 1) * 3 + k AS token, CASE k WHEN 0 THEN 10000 + l_quantity WHEN 1 THEN 10000 - l_discount * 100 ELSE l_tax * 1000 END AS x FROM lineitem, (SELECT unnest([0, 1, 2]) AS k)),
m AS (SELECT l_orderkey, max(x) AS top FROM v GROUP BY 1), s AS (SELECT l_orderkey, any_value(top) + ln(sum(exp(x - top))) AS z FROM v JOIN m USING (l_orderkey) GROUP BY 1)
SELECT l_orderkey, round(max(x) - any_value(z), 6) + 0 AS logp FROM s LEFT JOIN (SELECT * FROM v WHERE token = l_orderkey % 9) USING (l_orderkey) GROUP BY 1""",
)
def _logps(spark, sf_dir):
    """Lines of an order as parts of a vocabulary, three tokens each; large logits."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shards = i.select("l_orderkey", ((F.col("l_linenumber") - 1) * 3).alias("first"), F.array(10000 + F.col("l_quantity"), 10000 - F.col("l_discount") * 100, F.col("l_tax") * 1000).alias("logits"), (F.col("l_orderkey") % 9).alias("label"))
    return Q.token_logps(shards, ["l_orderkey"], "first", "logits", "label").select("l_orderkey", (r6(F.col("logp")) + 0.0).alias("logp"))


@query(
    "url_reasons",
    """WITH u AS (SELECT page_id, url, (page_id * 2654435761) % 4294967296 AS a FROM pages),
t AS (SELECT page_id, url, NULL AS a FROM u UNION ALL SELECT page_id, 'made', a FROM u)
SELECT page_id, a IS NOT NULL AS made, CASE WHEN a IS NULL THEN CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' THEN 'unresolved' ELSE 'scheme' END
 WHEN a IN (3221225481, 3221225482) THEN NULL
 WHEN a // 16777216 IN (0, 10, 127) OR a // 16777216 >= 240 OR a // 4194304 = 401 OR a // 65536 IN (43518, 49320) OR a // 1048576 = 2753 OR a // 131072 = 25353 OR a // 256 IN (12582912, 12582914, 12989028, 13303921) OR a // 65536 = 49320 THEN 'reserved' END AS reason FROM t""",
)
def _urls(spark, sf_dir):
    """Every page's own address, whose names nobody resolved, and one with a written number as its host."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    a = (F.col("page_id") * F.lit(2654435761)) % F.lit(4294967296)
    octet = lambda k: F.shiftrightunsigned(a, k).bitwiseAND(F.lit(255)).cast("string")
    dotted = F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))
    mapped = F.concat(F.lit("[::ffff:"), dotted, F.lit("]:8080"))
    host = F.when(F.col("page_id") % 3 == 0, dotted).when(F.col("page_id") % 3 == 1, mapped).otherwise(F.concat(F.lit("user:x@"), a.cast("string")))
    both = p.select("page_id", F.explode(F.array(F.struct(F.col("url"), F.lit(False).alias("made")), F.struct(F.concat(F.lit("https://"), host, F.lit("/a?b=http://c")).alias("url"), F.lit(True).alias("made")))).alias("s")).select("page_id", "s.*")
    return A.url_reasons(both, "url").select("page_id", "made", "reason")


@query(
    "path_reasons",
    "SELECT doc_id, '/media/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 4 WHEN 1 THEN 'outside' WHEN 2 THEN 'outside' END AS reason FROM documents",
)
def _paths(spark, sf_dir):
    """Paths in four spellings: inside, out and beside, up and out, up and in again."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    end = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    forms = ("/media//./", "/media/../media_other/", "/media/a/../../", "../media/b/../")
    path = F.element_at(F.array(*(F.concat(F.lit(f), end) for f in forms)), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = d.select("doc_id", end.alias("end"), path.alias("path"))
    return rows.select("doc_id", F.concat(F.lit("/media/"), "end").alias("path"), A.path_reason(F.col("path"), "/media", base="/work").alias("reason"))
