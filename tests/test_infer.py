"""Every chat template is found again from conversations rendered with it."""

from pyspark.sql import functions as F

from siftwell.functions import templates as T
from siftwell.operators import infer as I

MESSAGES = "array<struct<role: string, content: string>>"


def talks(spark, inner=False):
    rows = []
    for k in range(6):
        turns = [("user", f"ask {k} alpha"), ("assistant", f"reply {k} beta"), ("user", f"next {k} gamma"), ("assistant", f"last {k} delta"), ("user", f"more {k} eps"), ("assistant", f"done {k} zeta")][: 2 + 2 * (k % 3)]
        if inner:
            turns = [("user", f"ask {k}"), ("function", f"call {k}"), ("observation", f"found {k}"), ("assistant", f"reply {k}"), *turns]
        rows.append((k, turns, f"be {k} kind" if k % 2 else None))
    return spark.createDataFrame(rows, f"k int, m {MESSAGES}, s string")


def rendered(df, names):
    system = F.array(F.struct(F.lit("system").alias("role"), F.col("s").alias("content")))
    own = F.when(F.col("s").isNotNull(), F.concat(system, F.col("m"))).otherwise(F.col("m"))
    out = None
    for name in names:
        rows = df.select("k", own.alias("messages"), F.lit(name).alias("model"), F.array_join(T.render("m", T.TEMPLATES[name], "s", "</end>"), "").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def test_all_templates_are_recovered(spark, tmp_path):
    """What is inferred renders the same texts again, for every template; none is unclear."""
    rendered(talks(spark), T.TEMPLATES).write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    found = I.infer_templates(rows, "model", "messages", "text")
    found.write.parquet(str(tmp_path / "t"))
    found = spark.read.parquet(str(tmp_path / "t"))
    assert found.count() == len(T.TEMPLATES)
    assert [r.model for r in found.where("agreement < 1 OR size(unclear) > 0").collect()] == []
    assert I.fits(rows, found, "model", "messages", "text").where("NOT fits").count() == 0
    by = {r.model: r for r in found.collect()}
    assert by["qwen"].user == "<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n" and by["qwen"].system == "<|im_start|>system\n{{content}}<|im_end|>\n"
    assert by["llama2"].system_in_first_user and "{{idx}}" in by["chatglm2"].user


def test_calls_and_results(spark):
    found = I.infer_templates(rendered(talks(spark, True), ["qwen"]), "model", "messages", "text").first()
    t = T.TEMPLATES["qwen"]
    assert found.observation == t.observation and found.function == t.call.replace("{{eos}}", "</end>")


def test_what_texts_leave_open_is_named(spark):
    short = spark.createDataFrame([("m", [("user", "a b"), ("assistant", "c d")], "<u>a b<a>c d"), ("m", [("user", "lost")], "nothing here"), ("m", [], "x"), ("n", None, None)], f"model string, messages {MESSAGES}, text string")
    r = I.infer_templates(short, "model", "messages", "text").collect()
    assert len(r) == 1 and r[0].unclear == ["assistant>user"] and (r[0].prefix, r[0].user) == ("<u>", "{{content}}<a>")
    noisy = rendered(talks(spark), ["qwen"]).withColumn("text", F.when(F.col("k") == 2, F.concat(F.lit("?"), "text")).otherwise(F.col("text")))
    n = I.infer_templates(noisy, "model", "messages", "text").first()
    assert 0.5 < n.agreement < 1 and n.prefix == ""
    assert I.infer_templates(noisy.limit(0), "model", "messages", "text").count() == 0
