"""Streams with state: each group once, state that ends, the same rows after a restart."""

from collections import defaultdict
from datetime import datetime

import pytest

from siftwell.streaming import intake as I
from siftwell.streaming import stateful as S


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.with_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def fetch(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(df, path, log):
    q = df.writeStream.format("json").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return q


GROUPS = "uid string, row long, score double, ts timestamp"


def test_groups_fill_expire_and_leave_no_state(spark, tmp_path):
    at = lambda m: __import__("datetime").datetime(2024, 1, 1, m // 60, m % 60)
    folder, path, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    fetches = [
        [("a", i, 1.0, at(0)) for i in range(2)] + [("b", i, 5.0, at(0)) for i in range(3)] + [("dead", 1, 1.0, at(1))],
        [("a", 1, 9.0, at(2)), ("a", 2, 4.0, at(2)), ("a", 3, 100.0, at(2)), ("b", 7, 0.0, at(3))],  # a repeated row id, a row too many, one after the end
        [("late", 1, 1.0, at(600))],
        [("later", 1, 1.0, at(900))],
    ]

    def stream():
        return S.complete_groups(I.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1), "uid", "row", "score", "ts", 3, 1.5, 4.0, "1 hour", "0 minutes")

    for rows in fetches:  # the query is stopped and started again between the fetches
        fetch(spark, folder, rows, GROUPS)
        q = run(stream(), path, log)
    got = {r.uid: (r.status, r.n, r.mean) for r in spark.read.json(path).collect()}
    assert got == {"a": ("kept", 3, 2.0), "b": ("dropped", 3, 5.0), "dead": ("expired", 1, 1.0), "late": ("expired", 1, 1.0)}
    assert spark.read.json(path).count() == 4
    left = spark.read.format("statestore").option("path", log).option("stateVarName", "state").load()
    assert {r.key.uid for r in left.select("key").collect()} == {"later"}
    assert q.exception() is None


def test_batches_fill_over_fetches(spark, tmp_path):
    folder, path, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for k, names in enumerate((["g1", "g2"], ["g2", "g3"], ["g4", "g5", "g6", "g7", "g8"])):
        fetch(spark, folder, [(n, k) for n in names], "uid string, k int")
        run(S.filled_batches(I.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1), "uid", 3, 1, 5), path, log)
    rows = spark.read.json(path).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.batch, r.place)):
        by[r.batch].append(r.uid)
    assert by == {0: ["g1", "g2", "g3"], 1: ["g4", "g5", "g6"]} and {r.batch: r.tries for r in rows} == {0: 2, 1: 1}
    fetch(spark, folder, [("g9", 9)], "uid string, k int")  # g7, g8 and g9 are a batch
    run(S.filled_batches(I.read_stream(spark, folder, spark.read.parquet(folder).schema), "uid", 3, 1, 5), path, log)
    assert spark.read.json(path).where("batch = 2").count() == 3


def test_too_many_tries_end_the_query(spark, tmp_path):
    folder, path, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for i in range(2):
        fetch(spark, folder, [(f"g{i}", i)], "uid string, k int")
    with pytest.raises(Exception, match="1 fetches|2 fetches"):
        run(S.filled_batches(I.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1), "uid", 9, 1, 2), path, log)


def test_shuffle_gives_each_row_once_and_the_same_after_a_restart(spark, tmp_path):
    schema = "id long, text string, shard int, over boolean"
    rows = [(i, f"t{i}", i % 2, False) for i in range(400)]
    orders = []
    for way in ("whole", "stopped"):
        folder, path, log = (str(tmp_path / f"{way}-{n}") for n in ("in", "out", "log"))
        for k in range(4):
            fetch(spark, folder, rows[k * 100 : (k + 1) * 100] + ([(None, None, s, True) for s in (0, 1)] if k == 3 else []), schema)
            if way == "stopped":
                run(S.shuffled_stream(I.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1), "shard", "id", "over", 16, 7), path, log)
        if way == "whole":
            run(S.shuffled_stream(I.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1), "shard", "id", "over", 16, 7), path, log)
        out = spark.read.json(path).orderBy("_shard", "_at").collect()
        assert sorted(r.id for r in out) == list(range(400)) and all(r.text == f"t{r.id}" for r in out)
        orders.append([(r._shard, r._at, r.id) for r in out])
    assert orders[0] == orders[1]
    for s in (0, 1):
        ids = [i for shard, _, i in orders[0] if shard == s]
        assert ids != sorted(ids) and all(i % 2 == s for i in ids)
        # a row leaves after at least buffer later ones came in, but for the rest at the end
        assert all(ids.index(i) >= (i - s) / 2 - 16 for i in ids)


def test_means_at_a_bound_are_plain_averages(spark, tmp_path):
    """0.1, 0.2 and 0.3, added one after the other, pass 0.6: the average is over the bound, as SQL has it."""
    import duckdb

    folder, path, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    fetch(spark, folder, [("a", i, i / 10, datetime(2024, 1, 1)) for i in (1, 2, 3)], GROUPS)
    stream = I.read_stream(spark, folder, spark.read.parquet(folder).schema)
    run(S.complete_groups(stream, "uid", "row", "score", "ts", 3, 0.2, 1.0, "1 hour", "0 minutes"), path, log)
    ((mean, kept),) = duckdb.execute("SELECT avg(x), avg(x) > 0.2 FROM (SELECT unnest([0.1::DOUBLE, 0.2, i / 10]) AS x FROM range(3, 4) r(i))").fetchall()
    assert kept and [r.status for r in spark.read.json(path).collect()] == ["kept"] and mean > 0.2
