"""Queries that pass through files and streams: catalogs, sinks read back, dead letters, group accumulation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from siftwell.plans.catalog.convert import PAIRS, pairs
from siftwell.plans.registry import query
from siftwell.sources import catalog as K
from siftwell.sources import sinks as W
from siftwell.sources.scratch import scratch
from siftwell.streaming import intake as I
from siftwell.streaming import stateful as S


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query(
    "loaded_datasets",
    PAIRS
    + """SELECT 'asked' AS dataset, q AS prompt, o AS response, 1 AS n FROM (SELECT q, o FROM p)
UNION ALL SELECT 'chats', t[1].x, t[len(t)].x, CAST(len(t) - 1 AS INTEGER) FROM (SELECT list({'r': role, 'x': text} ORDER BY turn) AS t FROM conversations WHERE role <> 'system' GROUP BY conv_id) WHERE len(t) % 2 = 0 AND len([i FOR i IN range(1, len(t) + 1) IF t[i].r <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END]) = 0""",
)
def _loaded(spark, sf_dir):
    """Two datasets of a catalog, written as JSON lines and Parquet, read by extension, brought to one form."""
    base = scratch(spark, "datasets")
    p = pairs(spark, sf_dir).select("instruction", "output")
    p.write.json(f"{base}/asked.jsonl")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role <> 'system'")
    # whole conversations; those whose roles don't take turns are no example of this layout
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("s")).where(F.array_join(F.col("s.role"), ",").rlike("^user,assistant(,user,assistant)*$"))
    whole.select(F.transform("s", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["text"].alias("value"))).alias("conversations")).write.parquet(f"{base}/chats.parquet")
    entries = K.load_catalog({"asked": {"file_name": "asked.jsonl"}, "chats": {"file_name": "chats.parquet", "formatting": "sharegpt"}})
    rows = K.merged_datasets(spark, entries, ["asked", "chats"], base)
    return rows.select(F.col("_dataset").alias("dataset"), F.expr("_prompt[0].content").alias("prompt"), F.expr("_response[0].content").alias("response"), F.size("_prompt").alias("n"))


@query("sampled_datasets", "SELECT 'less' AS dataset, 10 AS n, 10 AS different UNION ALL SELECT 'more', 80, 25")
def _sampled(spark, sf_dir):
    """An entry's number of samples: fewer rows than there are, and more."""
    base = scratch(spark, "datasets")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("instruction"), F.lit("ok").alias("output"))
    n.write.parquet(f"{base}/nations.parquet")
    entries = K.load_catalog({"less": {"file_name": "nations.parquet", "num_samples": 10}, "more": {"file_name": "nations.parquet", "num_samples": 80}})
    rows = K.merged_datasets(spark, entries, ["less", "more"], base)
    g = rows.groupBy(F.col("_dataset").alias("dataset")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("_row").cast("int").alias("different"))
    return g


@query("common_columns", "SELECT n_name AS name, CAST(NULL AS VARCHAR) AS region, 'nations' AS dataset_name, 0 AS tags FROM nation UNION ALL SELECT NULL, r_name, 'regions', 0 FROM region")
def _common(spark, sf_dir):
    """Files whose columns differ, as one frame."""
    base = scratch(spark, "datasets")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name")).write.json(f"{base}/nations.jsonl")
    spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("region")).write.option("header", True).csv(f"{base}/regions.csv")
    schema = Y.StructType([Y.StructField("name", Y.StringType()), Y.StructField("region", Y.StringType()), Y.StructField("dataset_name", Y.StringType()), Y.StructField("tags", Y.ArrayType(Y.StringType()))])
    return K.load_common(spark, [f"{base}/nations.jsonl", f"{base}/regions.csv"], schema).withColumn("tags", F.size("tags"))


@query("named_files", "SELECT 'part' AS name, count(*) AS n FROM part")
def _named(spark, sf_dir):
    """The dataset's name from each row's file."""
    base = scratch(spark, "files")
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").write.parquet(f"{base}/part.parquet")
    rows = K.with_dataset_name(K.read(spark, f"{base}/part.parquet"))
    return rows.groupBy(F.regexp_extract("dataset_name", "^(part)", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("leaf_folders", "SELECT DISTINCT '/m/' || n_regionkey || '/' || n_nationkey AS folder FROM nation")
def _leaves(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = lambda *c: F.concat_ws("/", F.lit("/m"), *c)
    files = n.select(path("n_regionkey", "n_nationkey", F.lit("a.png")).alias("path")).unionByName(n.select(path("n_regionkey", F.lit("b.png")).alias("path")))
    return K.leaf_folders(files)


@query("cached_tables", "SELECT r_regionkey, r_name FROM region")
def _cached(spark, sf_dir):
    """Built once, then read."""
    path, built = scratch(spark, "cached"), []

    def build():
        built.append(1)
        return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")

    W.cached(spark, path, build)
    out = W.cached(spark, path, build)
    if len(built) != 1 or not W.exists(spark, path):
        raise AssertionError("the table was built more than once")
    return out


@query("saved_predictions", PAIRS + "SELECT q AS prompt, '! ' || o AS predict, o AS label FROM p WHERE turn % 4 <> 3")
def _predictions(spark, sf_dir):
    """Predictions by row key, read back; rows without one are left out."""
    path = scratch(spark, "predictions")
    rows = pairs(spark, sf_dir).select("id", F.col("instruction").alias("prompt"), F.col("output").alias("label"))
    W.save_predictions(rows, rows.where("id.turn % 4 <> 3").select("id", F.concat(F.lit("! "), F.col("label")).alias("predict")), "id", path)
    return spark.read.schema("prompt string, predict string, label string").json(path)


@query("saved_pair_scores", "SELECT round_even(o_totalprice / 7, 2) AS chosen, round_even(o_totalprice / 9, 2) AS rejected FROM orders")
def _pair_scores(spark, sf_dir):
    path = scratch(spark, "scores")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    W.save_pair_scores(o.select((F.col("o_totalprice") / 7).alias("chosen"), (F.col("o_totalprice") / 9).alias("rejected")), path)
    return spark.read.schema("chosen double, rejected double").json(path)


@query("appended_logs", "SELECT event_type, count(*) * 2 AS n FROM events GROUP BY event_type")
def _logs(spark, sf_dir):
    path = scratch(spark, "log")
    for _ in range(2):
        W.append_log(events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("event_type string, n long").json(path).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("written_points", "SELECT CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_size % 7 AS DOUBLE) AS class_id FROM part")
def _points(spark, sf_dir):
    """Points as ASCII PLY files, read back."""
    path = scratch(spark, "points")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    W.write_points(p.select(F.col("p_partkey").cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), (F.col("p_size") % 7).alias("class_id")), path)
    return K.read(spark, path, kind="ply").select("x", "y", "class_id")


def _source(spark, sf_dir, rows, files: int = 4) -> str:
    """Rows as a folder that a stream reads file by file."""
    path = scratch(spark, "stream")
    rows.repartition(files).write.parquet(path)
    return path


@query("dead_letters", "SELECT event_id, event_id * 2 AS doubled, CAST(NULL AS VARCHAR) AS row FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT NULL, NULL, CAST(event_id AS VARCHAR) FROM events WHERE event_id % 10 = 3")
def _dead(spark, sf_dir):
    """A stream whose function fails on some rows; they are kept apart with their text."""
    e = events(spark, sf_dir).select("event_id")

    def double(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["event_id"] % 10 == 3).any():
            raise ValueError("three")
        return pd.DataFrame({"event_id": pdf["event_id"], "doubled": pdf["event_id"] * 2})

    # one task a file: their number follows the rows
    stream = I.read_stream(spark, _source(spark, sf_dir, e, max(4, e.count() // 50_000)), e.schema)
    path, log = scratch(spark, "letters"), scratch(spark, "log")
    rows = I.with_dead_letters(stream, double, "event_id long, doubled long", "event_id")
    I.append_json(rows, path, log).awaitTermination()
    got = spark.read.schema("event_id long, doubled long, _error string, _row string").json(path)
    return I.good_rows(got).withColumn("row", F.lit(None).cast("string")).unionByName(I.bad_rows(got).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("doubled"), F.col("_row").alias("row")))


@query("accumulated_groups", "SELECT event_id // 50 AS uid, CASE WHEN avg(value) > 45 AND avg(value) < 55 THEN 'kept' ELSE 'dropped' END AS status, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1 HAVING count(*) = 50")
def _accumulated(spark, sf_dir):
    """Groups of fifty responses that arrive over several triggers, each given out once it is complete."""
    S.with_state_store(spark)
    e = events(spark, sf_dir).select(F.floor(F.col("event_id") / 50).alias("uid"), "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    stream = I.read_stream(spark, _source(spark, sf_dir, e), e.schema, files_per_trigger=2)
    path, log = scratch(spark, "groups"), scratch(spark, "log")
    I.append_json(S.complete_groups(stream, "uid", "event_id", "value", "ts", 50, 45.0, 55.0, patience="36500 days", late="36500 days"), path, log).awaitTermination()
    return spark.read.schema("uid long, status string, n long, mean double").json(path).withColumn("mean", F.round("mean", 4))


@query("batches_of_groups", "SELECT batch, 16 AS n FROM (SELECT unnest(range(CAST(count(DISTINCT user_id) // 16 AS BIGINT))) AS batch FROM events)")
def _filled(spark, sf_dir):
    """Users as groups, gathered over several fetches until sixteen make a batch."""
    S.with_state_store(spark)
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    stream = I.read_stream(spark, _source(spark, sf_dir, e), e.schema, files_per_trigger=1)
    path, log = scratch(spark, "groups"), scratch(spark, "log")
    I.append_json(S.filled_batches(stream, "user_id", 16), path, log).awaitTermination()
    return spark.read.schema("batch long, place int, user_id string").json(path).groupBy("batch").agg(F.count_distinct("user_id", "place").cast("int").alias("n"))


@query("shuffled_stream", "SELECT CAST(event_id % 4 AS INTEGER) AS shard, count(*) AS n, count(*) AS places, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _streamed(spark, sf_dir):
    """Every event once, through buffers of 512 rows that last over the triggers."""
    S.with_state_store(spark)
    e = events(spark, sf_dir).select("event_id", "value", (F.col("event_id") % 4).cast("int").alias("shard"), F.lit(False).alias("over"))
    folder = _source(spark, sf_dir, e)
    spark.range(4).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"), F.col("id").cast("int").alias("shard"), F.lit(True).alias("over")).coalesce(1).write.mode("append").parquet(folder)
    stream = I.read_stream(spark, folder, e.schema, files_per_trigger=2)
    path, log = scratch(spark, "shuffled"), scratch(spark, "log")
    I.append_json(S.shuffled_stream(stream, "shard", "event_id", "over", buffer=512), path, log).awaitTermination()
    got = spark.read.schema("event_id long, _shard int, _at long").json(path)
    return got.groupBy(F.col("_shard").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_at").alias("places"), F.sum("event_id").alias("ids"))


@query("batches_seen", "SELECT count(*) AS n, round(sum(value), 2) AS total FROM events")
def _batches(spark, sf_dir):
    """Every micro-batch of a stream handed to a function once."""
    e = events(spark, sf_dir).select("event_id", "value")
    path = scratch(spark, "batches")
    I.for_each_batch(I.read_stream(spark, _source(spark, sf_dir, e), e.schema, files_per_trigger=1), lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"), scratch(spark, "log")).awaitTermination()
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
