"""Readers, catalog, sinks, templates, tools and streams on small files."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.functions import templates as M
from siftwell.functions import tools as K
from siftwell.sources import catalog as C
from siftwell.sources import sinks as S
from siftwell.streaming import intake as I

TOOL = {"name": "test_tool", "description": "tool_desc", "parameters": {"type": "object", "properties": {"foo": {"type": "string", "description": "foo_desc"}, "bar": {"type": "number", "description": "bar_desc"}}, "required": ["foo"]}}


def test_catalog_and_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"instruction": "q", "output": "a"}, {"instruction": "r", "output": "b"}]))
    (tmp_path / "b.jsonl").write_text('{"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}\n\n')
    cat = C.load_catalog({"one": {"file_name": "a.json"}, "two": {"file_name": "b.jsonl", "formatting": "sharegpt"}})
    got = C.load_datasets(spark, cat, ["one", "two"], str(tmp_path))
    assert {n: d.count() for n, d in got.items()} == {"one": 2, "two": 1}
    rows = C.canonical(got["two"].withColumn("k", F.lit(1)), cat["two"], "k").first()
    assert rows._prompt[0].content == "x" and rows._response[0].content == "y"
    assert C.canonical(got["one"].withColumn("k", F.lit(1)), cat["one"], "k").count() == 2
    with pytest.raises(KeyError):
        C.load_datasets(spark, cat, ["three"])
    with pytest.raises(ValueError):
        C.load_datasets(spark, cat, ["one"], str(tmp_path), ranking=True)
    assert C.load_catalog(str(tmp_path / "none.json")) == {}


def test_arrow_and_ply(spark, tmp_path):
    table = pa.table({"a": [1, 2, 3], "s": ["x", None, "z"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert sorted((r.a, r.s) for r in C.read(spark, str(tmp_path / "t.arrow")).collect()) == [(1, "x"), (2, None), (3, "z")]
    points = spark.createDataFrame([(0.5, 1.0, -2.25, 7)], "x double, y double, z double, class_id int")
    S.write_points(points, str(tmp_path / "p"))
    r = C.read(spark, str(tmp_path / "p"), kind="ply").first()
    assert (r.x, r.y, r.z, r.class_id) == (0.5, 1.0, -2.25, 7.0) and r.file.endswith(".ply")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "c")
    built = []
    for _ in range(2):
        df = S.cached(spark, path, lambda: built.append(1) or spark.range(3).toDF("i"))
        assert df.count() == 3
    assert built == [1]
    t = str(tmp_path / "steps")
    assert S.latest_step(spark, t) is None
    for step, score in ((1, 0.5), (2, 0.9), (3, 0.7)):
        S.record_step(spark, t, step, score)
    assert (S.latest_step(spark, t), S.best_step(spark, t)) == (3, 2)
    S.write_matrix(spark, [[1.0, 0.5], [0.0, 1.0]], str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["1.00000000 0.50000000", "0.00000000 1.00000000"]


def test_templates(spark):
    df = spark.createDataFrame([([("user", "How are you"), ("assistant", "I am fine"), ("user", "Bye"), ("assistant", "Ok")],)], "m array<struct<role: string, content: string>>")
    turns = df.select(M.render("m", M.resolve("qwen")).alias("t")).first().t
    assert turns[0] == "<|im_start|>system\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\n<|im_start|>user\nHow are you<|im_end|>\n<|im_start|>assistant\n" and turns[1] == "I am fine<|im_end|>\n"
    assert df.select(M.render("m", M.resolve("llama2", system="Be."), begin_token="<b>").alias("t")).first().t[0] == "<b>[INST] <<SYS>>\nBe.\n<</SYS>>\n\nHow are you [/INST]"
    got = df.withColumn("t", M.render("m", M.resolve("default"), end_token="</s>")).select(M.turn_pairs("t").alias("p"), M.prompt_and_response("t").alias("r")).first()
    assert [tuple(x) for x in got.p] == [("Human: How are you</s>\nAssistant:", "I am fine</s>\n"), ("Human: Bye</s>\nAssistant:", "Ok</s>\n")] and got.r.response == "Ok</s>\n"
    with pytest.raises(ValueError):
        M.register_template("qwen", M.Template())


def test_tools(spark):
    call = json.dumps({"name": "tool_name", "arguments": {"foo": "bar", "size": 10}})
    assert K.write_calls(call) == 'Action: tool_name\nAction Input: {"foo": "bar", "size": 10}'
    text = K.describe_tools(json.dumps([TOOL]))
    assert "> Tool Name: test_tool\nTool Description: tool_desc\nTool Args:\n  - foo (string, required): foo_desc\n  - bar (number): bar_desc\n\n" in text and "(one of [test_tool])" in text
    two = json.dumps([{"name": "a", "arguments": {"x": "1", "n": [1, 2]}}, {"name": "b", "arguments": {"y": "é"}}])
    for fmt in ("default", "llama3", "mistral", "qwen", "ling"):
        assert K.read_calls(K.write_calls(two, fmt), fmt) == [("a", '{"x": "1", "n": [1, 2]}'), ("b", '{"y": "é"}')]
        assert K.read_calls("no call here", fmt) == "no call here"
    seed = K.read_calls(K.write_calls(json.dumps({"name": "f", "arguments": {"k": "text"}}), "seed_oss").replace("<function=f\n", "<function=f\n"), "seed_oss")
    assert seed == [("f", '{"k": "text"}')] and K.read_calls("none", "seed_oss") == []
    assert K.read_calls(K.write_calls(call, "glm4"), "glm4") == [("tool_name", '{"foo": "bar", "size": 10}')]
    assert all(K.describe_tools(json.dumps([TOOL]), f) for f in K.FORMATS)
    df = K.with_calls(spark.createDataFrame([(K.write_calls(call),), ("nothing",), (None,)], "t string"), "t")
    assert [r.calls and r.calls[0].name for r in df.collect()] == ["tool_name", None, None]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    events.select("event_id", "ts", "user_id", "value").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = I.read_stream(spark, folder, schema, files_per_trigger=1)
    q = I.windowed_means(stream, "ts", "value", "1 day").writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.table("days").columns == ["start", "n", "mean"]
    seen = []
    I.for_each_batch(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c3")).awaitTermination(120)
    assert sum(n for _, n in seen) == events.count()


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x"), (3, "3")], "id int, s string").coalesce(1)
    made = I.with_dead_letters(df, lambda p: p.assign(n=p["s"].astype(int))[["id", "n"]], "id int, n int", "s")
    assert sorted((r.id, r.n) for r in I.good_rows(made).collect()) == [(1, 1), (3, 3)]
    bad = I.bad_rows(made).collect()
    assert len(bad) == 1 and bad[0]._row == "x" and bad[0]._error.startswith("ValueError")


def test_dead_letters_take_few_calls(spark):
    """A few bad rows don't make a batch go row by row, and pieces of different types keep large integers."""
    calls = spark.sparkContext.accumulator(0)

    def checked(p):
        calls.add(1)
        if (p["id"] % 1000 == 7).any():
            raise ValueError("seven")
        n = p["id"] + 2**60
        return p.assign(n=n.astype(object).where(p["id"] != 3, None) if len(p) < 20 else n)[["id", "n"]]

    made = I.with_dead_letters(spark.range(0, 4000, 1, 1), checked, "id long, n long", "id").collect()
    good = {r.id: r.n for r in made if r._error is None}
    assert good == {i: None if i == 3 else i + 2**60 for i in range(4000) if i % 1000 != 7}
    assert sorted((r._row, r._error) for r in made if r._error is not None) == sorted((str(i), "ValueError: seven") for i in range(7, 4000, 1000))
    assert calls.value < 120


def test_equal_texts_are_made_once_a_batch(spark):
    calls = spark.sparkContext.accumulator(0)

    def made(x):
        calls.add(1)
        return None if x == "t1" else x.upper()

    df = spark.range(0, 3000, 1, 1).selectExpr("id", "if(id % 4 = 3, null, 't' || id % 4) AS t")
    got = {r.id: (r.t, r.u) for r in K._with_made(df, "t", "u", "string", pa.string(), made).collect()}
    assert got == {i: (None, None) if i % 4 == 3 else (f"t{i % 4}", None if i % 4 == 1 else f"T{i % 4}") for i in range(3000)}
    assert calls.value == 3
