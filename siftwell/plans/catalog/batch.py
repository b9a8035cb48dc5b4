"""Queries of batch algebra over orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import batch as B
from siftwell.plans.registry import query


def orders(spark, sf_dir, *cols):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *cols)


NUM = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)"


@query("select_known_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def _select(spark, sf_dir):
    return B.select(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderkey", "no_such_column", "o_orderstatus"])


@query("pop_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _pop(spark, sf_dir):
    return B.pop(orders(spark, sf_dir, "o_totalprice", "o_orderstatus"), ["o_totalprice"], "o_orderkey")[0]


@query("rename_columns", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def _rename(spark, sf_dir):
    return B.rename(orders(spark, sf_dir, "o_orderstatus"), ["o_orderkey", "o_orderstatus"], ["id", "status"])


@query("horizontal_union", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders")
def _hunion(spark, sf_dir):
    return B.horizontal_union(orders(spark, sf_dir, "o_orderstatus", "o_totalprice"), orders(spark, sf_dir, "o_totalprice", "o_custkey"), "o_orderkey")


@query("concat_batches", "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def _concat(spark, sf_dir):
    a = orders(spark, sf_dir, "o_orderstatus").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return B.concat([a, spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))])


@query("slice_rows", f"SELECT o_orderkey FROM {NUM} WHERE pos >= 10 AND pos < (SELECT count(*) FROM orders) - 20 AND (pos - 10) % 3 = 0")
def _slice(spark, sf_dir):
    return B.slice_rows(orders(spark, sf_dir), "o_orderkey", 10, -20, 3)


@query("slice_backwards", f"SELECT o_orderkey FROM {NUM} WHERE pos <= (SELECT count(*) FROM orders) - 2 AND ((SELECT count(*) FROM orders) - 2 - pos) % 5 = 0")
def _slice_back(spark, sf_dir):
    return B.slice_rows(orders(spark, sf_dir), "o_orderkey", -2, None, -5)


@query("gather_positions", f"SELECT CAST(c_custkey AS BIGINT) AS at, o_orderkey FROM customer JOIN {NUM} n ON n.pos = (c_custkey * 7) % 100")
def _gather(spark, sf_dir):
    want = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("at"), ((F.col("c_custkey") * 7) % 100).alias("source"))
    return B.take_positions(orders(spark, sf_dir), "o_orderkey", want)


@query("chunk_equal", f"SELECT o_orderkey, CAST(floor(pos / ((SELECT count(*) FROM orders) / 5)) AS INTEGER) AS chunk FROM {NUM}")
def _chunk(spark, sf_dir):
    return B.chunk(orders(spark, sf_dir), "o_orderkey", 5)


@query("split_by_size", f"SELECT o_orderkey, CAST(floor(pos / 64) AS INTEGER) AS chunk FROM {NUM}")
def _split(spark, sf_dir):
    return B.split(orders(spark, sf_dir), "o_orderkey", 64)


@query("repeat_interleaved", f"SELECT o_orderkey, CAST(pos * 3 + c AS BIGINT) AS pos FROM {NUM}, range(3) r(c)")
def _repeat(spark, sf_dir):
    return B.repeat(orders(spark, sf_dir), "o_orderkey", 3).select("o_orderkey", F.col("_pos").alias("pos"))


@query("repeat_whole", f"SELECT o_orderkey, CAST(c * (SELECT count(*) FROM orders) + pos AS BIGINT) AS pos FROM {NUM}, range(3) r(c)")
def _repeat_whole(spark, sf_dir):
    return B.repeat(orders(spark, sf_dir), "o_orderkey", 3, interleave=False).select("o_orderkey", F.col("_pos").alias("pos"))


@query(
    "pad_to_divisor",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(pos AS BIGINT) AS pos, false AS padded FROM n UNION ALL SELECT c_custkey, CAST(n + pos AS BIGINT), true FROM n WHERE pos < (7 - n % 7) % 7""",
)
def _pad(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return B.pad_to_divisor(c, "c_custkey", 7).select("c_custkey", F.col("_pos").alias("pos"), F.col("_padded").alias("padded"))


@query("unpad", "SELECT c_custkey FROM customer")
def _unpad(spark, sf_dir):
    return B.unpad(B.pad_to_divisor(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey", 7)).select("c_custkey")


@query("reorder_and_back", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS pos FROM customer")
def _reorder(spark, sf_dir):
    rows = B.with_position(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    most = F.broadcast(rows.agg(F.max("_pos").alias("_most")))  # one row
    shift = rows.crossJoin(most).select(F.col("_pos").alias("old"), (F.col("_most") - F.col("_pos")).alias("new"))
    return B.reorder(B.reorder(rows, shift), B.inverse_permutation(shift)).select("c_custkey", F.col("_pos").alias("pos"))


@query("fold_batch", f"SELECT CAST(floor(pos / 4) AS INTEGER) AS chunk, sum(o_custkey)::BIGINT AS total, count(*) AS n FROM {NUM} GROUP BY 1")
def _fold(spark, sf_dir):
    f = B.fold_batch(orders(spark, sf_dir, "o_custkey"), "o_orderkey", 4)
    return f.select("chunk", F.expr("aggregate(o_custkey, 0L, (a, x) -> a + x)").alias("total"), F.size("o_custkey").cast("long").alias("n"))


@query("map_round_trip", "SELECT event_id, event_type || '/value' AS key, value FROM events")
def _maps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.create_map(F.concat("event_type", F.lit("/value")), "value").alias("m"))
    e = e.withColumn("nested", B.unflatten_map("m")).withColumn("flat", B.flatten_map("nested")).withColumn("both", B.merge_maps("m", "flat"))
    return e.select("event_id", F.explode("both").alias("key", "value"))


@query("append_to_lists", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def _append(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("event_id").cast("string").alias("s"))
    return B.append_to_lists(e, "user_id", "s", "event_id").select("user_id", F.array_join("values", ",").alias("ids"))


@query("held_bytes", "SELECT 'doc_id' AS \"column\", count(doc_id) * 8 AS bytes FROM documents UNION ALL SELECT 'text', CAST(sum(strlen(text)) AS BIGINT) FROM documents UNION ALL SELECT 'lang', CAST(sum(strlen(lang)) AS BIGINT) FROM documents UNION ALL SELECT 'source', CAST(sum(strlen(source)) AS BIGINT) FROM documents UNION ALL SELECT 'n_chars', count(n_chars) * 8 FROM documents")
def _held(spark, sf_dir):
    return B.held_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
