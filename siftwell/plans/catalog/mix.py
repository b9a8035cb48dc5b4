"""Queries of sampling, splitting, interleaving and batch planning over orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import mix as M
from siftwell.plans.registry import query


def orders(spark, sf_dir, *cols):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *cols)


def customers(spark, sf_dir, *cols):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", *cols)


def draw(key, seed="42"):
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


@query("sample_head", f"SELECT o_orderkey FROM orders ORDER BY {draw('o_orderkey')}, o_orderkey LIMIT 100")
def _head(spark, sf_dir):
    return M.resample(orders(spark, sf_dir), "o_orderkey", 100).select("o_orderkey")


@query(
    "resample_with_replacement",
    f"""WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY {draw('c_custkey')}, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
d AS (SELECT id + 1 AS draw, CAST(floor(CAST(('0x' || substr(md5('42+:' || CAST(id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 * (SELECT count(*) FROM customer)) AS BIGINT) AS pos FROM range(100) r(id))
SELECT c_custkey, CAST(0 AS BIGINT) AS draw FROM customer UNION ALL SELECT c_custkey, draw FROM n JOIN d USING (pos)""",
)
def _resample(spark, sf_dir):
    c = customers(spark, sf_dir)
    return M.resample(c, "c_custkey", c.count() + 100).select("c_custkey", F.col("_draw").alias("draw"))


@query("max_samples_head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 77")
def _max(spark, sf_dir):
    return M.head(orders(spark, sf_dir), "o_orderkey", 77)


@query("preview_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2 OFFSET 6")
def _page(spark, sf_dir):
    return M.page(orders(spark, sf_dir), "o_orderkey", 3)


@query("pick_by_rank", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE r = greatest(1, least(4, n))")
def _rank(spark, sf_dir):
    return M.by_rank(orders(spark, sf_dir, "o_custkey"), "o_custkey", "o_orderkey", 4).select("o_custkey", "o_orderkey")


SPLIT = f"(SELECT o_orderkey FROM orders ORDER BY {draw('o_orderkey')}, o_orderkey LIMIT (SELECT CAST(ceil(0.1 * count(*)) AS BIGINT) FROM orders))"


@query("split_train", f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN {SPLIT}")
def _train(spark, sf_dir):
    return M.split(orders(spark, sf_dir), "o_orderkey", 0.1)[0]


@query("split_validation", f"SELECT o_orderkey FROM orders WHERE o_orderkey IN {SPLIT}")
def _validation(spark, sf_dir):
    return M.split(orders(spark, sf_dir), "o_orderkey", 0.1)[1]


def _two(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return [customers(spark, sf_dir, "c_name").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), s]


TWO = """WITH a AS (SELECT c_custkey AS id, c_name AS name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
b AS (SELECT s_suppkey AS id, s_name AS name, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
"""


@query("union_all", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _union(spark, sf_dir):
    return M.union_all(_two(spark, sf_dir))


@query("interleave_under", TWO + "SELECT id, name, CAST(pos * 2 AS BIGINT) AS at FROM a, n WHERE pos < least(na, nb) UNION ALL SELECT id, name, CAST(pos * 2 + 1 AS BIGINT) FROM b, n WHERE pos < least(na, nb)")
def _under(spark, sf_dir):
    return M.interleave(_two(spark, sf_dir), "id").select("id", "name", F.col("_at").alias("at"))


@query(
    "interleave_over",
    TWO + "SELECT a.id, a.name, CAST(k * 2 AS BIGINT) AS at FROM range(100000) r(k), n, a WHERE k < greatest(na, nb) AND a.pos = k % na UNION ALL SELECT b.id, b.name, CAST(k * 2 + 1 AS BIGINT) FROM range(100000) r(k), n, b WHERE k < greatest(na, nb) AND b.pos = k % nb",
)
def _over(spark, sf_dir):
    return M.interleave(_two(spark, sf_dir), "id", "over").select("id", "name", F.col("_at").alias("at"))


@query(
    "interleave_by_probability",
    TWO
    + """, d AS (SELECT i AS "at", CASE WHEN CAST(('0x' || substr(md5('42:' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.7 THEN 0 ELSE 1 END AS source FROM range(300) r(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "at") - 1 AS k FROM d)
SELECT k."at", k.source, a.id FROM k, n, a WHERE source = 0 AND a.pos = k.k % na UNION ALL SELECT k."at", k.source, b.id FROM k, n, b WHERE source = 1 AND b.pos = k.k % nb""",
)
def _probability(spark, sf_dir):
    return M.interleave_by_probability(_two(spark, sf_dir), "id", [0.7, 0.3], 300).select(F.col("_at").alias("at"), F.col("_source").alias("source"), "id")


def stopped(which: str) -> str:
    """The SQL of draws that end with a source's last row."""
    return (
        TWO
        + f""", d AS (SELECT i AS "at", CASE WHEN CAST(('0x' || substr(md5('42:' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.7 THEN 0 ELSE 1 END AS source FROM n, LATERAL (SELECT unnest(range(5 * (na + nb) + 1000)) AS i)),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "at") - 1 AS k FROM d),
e AS (SELECT {which}("at") AS last FROM k, n WHERE (source = 0 AND k = na - 1) OR (source = 1 AND k = nb - 1))
SELECT k."at", k.source, a.id FROM k, e, n, a WHERE "at" <= last AND source = 0 AND a.pos = k.k % na UNION ALL SELECT k."at", k.source, b.id FROM k, e, n, b WHERE "at" <= last AND source = 1 AND b.pos = k.k % nb"""
    )


@query("interleave_until_first", stopped("min"))
def _first(spark, sf_dir):
    return M.interleave_by_probability(_two(spark, sf_dir), "id", [0.7, 0.3]).select(F.col("_at").alias("at"), F.col("_source").alias("source"), "id")


@query("interleave_until_all", stopped("max"))
def _all(spark, sf_dir):
    return M.interleave_by_probability(_two(spark, sf_dir), "id", [0.7, 0.3], stop="all").select(F.col("_at").alias("at"), F.col("_source").alias("source"), "id")


@query(
    "capped_sample",
    f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {draw('o_orderkey')}, o_orderkey) AS r FROM orders)
SELECT o_orderkey, o_orderpriority FROM r WHERE r <= CASE o_orderpriority WHEN '1-URGENT' THEN 20 WHEN '5-LOW' THEN 35 ELSE 1000000000 END""",
)
def _capped(spark, sf_dir):
    return M.capped_sample(orders(spark, sf_dir, "o_orderpriority"), "o_orderpriority", "o_orderkey", {"1-URGENT": 20, "5-LOW": 35})


@query(
    "modality_batches",
    """WITH r AS (SELECT o_orderkey, o_orderstatus AS modality, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('45:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
b AS (SELECT o_orderkey, modality, CAST(floor(pos / 16) AS INTEGER) AS batch FROM r WHERE pos < n // 16 * 16),
p AS (SELECT modality, batch, row_number() OVER (ORDER BY md5('45plan:' || modality || '#' || CAST(batch AS VARCHAR))) - 1 AS plan FROM (SELECT DISTINCT modality, batch FROM b))
SELECT o_orderkey, modality, batch, CAST(plan AS BIGINT) AS plan FROM b JOIN p USING (modality, batch)""",
)
def _modality(spark, sf_dir):
    o = orders(spark, sf_dir, "o_orderstatus").withColumnRenamed("o_orderstatus", "modality")
    return M.modality_batches(o, "modality", "o_orderkey", 16, 42, 3).select("o_orderkey", "modality", "batch", "plan")


@query(
    "resume_batches",
    """WITH r AS (SELECT o_orderkey, o_orderstatus AS modality, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
b AS (SELECT o_orderkey, modality, floor(pos / 16) AS batch FROM r WHERE pos < n // 16 * 16),
p AS (SELECT modality, batch, row_number() OVER (ORDER BY md5('42plan:' || modality || '#' || CAST(CAST(batch AS INTEGER) AS VARCHAR))) - 1 AS plan FROM (SELECT DISTINCT modality, batch FROM b))
SELECT o_orderkey FROM b JOIN p USING (modality, batch) WHERE plan >= 5""",
)
def _resume(spark, sf_dir):
    o = orders(spark, sf_dir, "o_orderstatus").withColumnRenamed("o_orderstatus", "modality")
    return M.skip_consumed(M.modality_batches(o, "modality", "o_orderkey", 16), 5).select("o_orderkey")


@query(
    "buffered_shuffle",
    f"""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY floor(pos / 128), {draw('o_orderkey')}, o_orderkey) - 1 AS BIGINT) AS at FROM n""",
)
def _buffered(spark, sf_dir):
    return M.buffered_shuffle(orders(spark, sf_dir), "o_orderkey", "o_orderkey", 128).select("o_orderkey", F.col("_at").alias("at"))


@query("minibatch_epochs", "WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT c_custkey, CAST(floor(pos / 32) AS INTEGER) AS batch, CAST(e AS INTEGER) AS epoch FROM n, range(2) r(e)")
def _mini(spark, sf_dir):
    return M.minibatches(customers(spark, sf_dir), "c_custkey", 32, 2)
