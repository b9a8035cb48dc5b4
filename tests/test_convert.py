"""Literal goldens of the converters and of the token operators."""

from pyspark.sql import functions as F

from siftwell.operators import convert as C
from siftwell.operators import tokens as T


def test_instruction_record(spark):
    df = spark.createDataFrame([(1, "Solve the math problem.", "3 + 4", "The answer is 7.")], "id int, instruction string, input string, output string")
    r = C.alpaca(df, "id").first()
    assert [tuple(m) for m in r._prompt] == [("user", "Solve the math problem.\n3 + 4")]
    assert [tuple(m) for m in r._response] == [("assistant", "The answer is 7.")]
    assert (r._system, r._tools, r._images) == ("", "", None)


def test_tagged_record(spark):
    schema = "id int, conversations array<struct<from: string, value: string>>"
    rows = [(1, [("system", "S"), ("human", "Q"), ("gpt", "A")]), (2, [("human", "Q"), ("human", "Q")]), (3, [("human", "Q")]), (4, [("tool", "Q"), ("gpt", "A")]), (5, []), (6, None)]
    got = {r.id: r for r in C.sharegpt(spark.createDataFrame(rows, schema), "id").collect()}
    assert got[1]._system == "S" and [tuple(m) for m in got[1]._prompt] == [("user", "Q")] and [tuple(m) for m in got[1]._response] == [("assistant", "A")]
    assert all(got[i]._prompt == [] and got[i]._response == [] for i in (2, 3, 4, 5, 6))
    assert C.sharegpt_v1(spark.createDataFrame(rows[3:4], schema), "id").first().messages == []


def test_tool_calls(spark):
    schema = "id int, messages array<struct<role: string, content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>, tools string"
    call = ("assistant", None, [(("f", "{}"),)])
    rows = [(1, [("system", "S", None), ("user", "Q", None), call, ("tool", "x", None), ("tool", "y", None), ("assistant", "A", None)], "t"), (2, [("user", "Q", None), ("assistant", "A", None), ("tool", "lost", None)], "")]
    got = {r.id: r for r in C.openai(spark.createDataFrame(rows, schema), "id", tools="tools").collect()}
    assert [m.role for m in got[1]._prompt] == ["user", "function", "observation"]
    assert got[1]._prompt[2].content == "x\n</tool_response>\n<tool_response>\ny"
    assert got[1]._prompt[1].content == '[{"name":"f","arguments":"{}"}]'
    assert got[1]._system == "S" and got[2]._system == "detailed thinking off"
    assert [m.content for m in got[2]._response] == ["A"]


def test_pairs_and_few_shot(spark):
    m = "array<struct<role: string, content: string>>"
    df = spark.createDataFrame([(1, [("user", "q"), ("tool", "t"), ("assistant", "a")], [("user", "q"), ("assistant", "b")])], f"id int, chosen {m}, rejected {m}")
    r = C.pair_v1(df, "id").first()
    assert [x.role for x in r.chosen_messages] == ["user", "assistant"] and r.rejected_messages[1].content[0].value == "b"
    q = "question string, A string, B string, C string, D string, answer string"
    ex, sup = spark.createDataFrame([(7, "Q", "1", "2", None, None, "B")], f"id int, {q}"), spark.createDataFrame([(0, "P", "1", "2", "3", "4", "A")], f"shot int, {q}")
    messages = C.few_shot(ex, sup, "id", "math").first().messages
    assert len(messages) == 4 and messages[2].content == "Q\nA. 1\nB. 2\nAnswer:" and messages[0].content.startswith("The following are multiple choice questions (with answers) about math.\n\nP")


def test_truncation_goldens(spark):
    cases = [(3000, 2000, 600, 400), (2000, 3000, 400, 600), (1000, 100, 900, 100), (100, 1000, 100, 900), (100, 500, 100, 500), (500, 100, 500, 100), (10, 10, 10, 10)]
    df = spark.createDataFrame([c[:2] for c in cases], "s long, t long")
    s, t = T.truncation(F.col("s"), F.col("t"), 1000)
    assert [tuple(r) for r in df.select(s, t).collect()] == [c[2:] for c in cases]
    assert [tuple(x) for x in spark.sql("select array(3000, 10) s, array(2000, 10) t").select(T.truncation_budgets("s", "t", 1010).alias("b")).first().b][0] == (606, 404)


def test_segments(spark):
    df = spark.createDataFrame([(0, [1, 1, 2, 2, 2, 0]), (1, [1, 2, 2, 3, 3, 3])], "i int, m array<int>")
    assert [r.n for r in df.orderBy("i").select(T.segment_lengths("m").alias("n")).collect()] == [[2, 3], [1, 2, 3]]
    places = T.token_places(df, "i", "m").orderBy("place").collect()
    assert [r["index"] for r in places] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11] and [r.place for r in places] == list(range(11))
    ends = T.cumulative_lengths(df, "i", "m").orderBy("end").collect()
    assert [r.end for r in ends] == [2, 5, 6, 8, 11] and max(r.length for r in ends) == 3
    mask = df.where("i = 0").select(T.block_causal_mask("m").alias("x")).first().x
    assert mask == [[1, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 1, 1, 0, 0], [0, 0, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0]]


def test_response_mask(spark):
    from siftwell.operators import groupstats as G

    df = spark.createDataFrame([([0, 0, 2, 4, 3, 5, 1, 0, 0],)], "ids array<int>")
    assert df.select(G.response_mask("ids", 1).alias("m")).first().m == [1, 1, 1, 1, 1, 1, 1, 0, 0]


def test_packing_and_balancing(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([7, 3, 9, 4, 4, 2, 11])], "b int, k int, n int")
    bins = T.knapsack(df, "b", "k", "n", 10).collect()
    assert {r.k for r in bins} == {0, 1, 2, 3, 4, 5}
    held = {}
    for r in bins:
        held[r.bin] = held.get(r.bin, 0) + [7, 3, 9, 4, 4, 2, 11][r.k]
    assert max(held.values()) <= 10 and held[0] == 9
    # by hand: 8-7=1, 6-5=1, 4-1=3, 3-1=2, so the sums are 16 and 14
    two = T.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum(two, [])) == list(range(5)) and sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in two) == [14, 16]
    equal = T.differencing([5, 1, 9, 3, 7, 2], 3, equal_size=True)
    assert all(len(s) == 2 for s in equal) and sorted(sum(equal, [])) == list(range(6))
    assert T.least_loaded([1, 2, 3, 4], 2, True) == [[0, 2], [1, 3]]
    parts = T.micro_batches(df, "b", "k", "n", 20).collect()
    assert {r.part for r in parts} == {0, 1}
    packed = T.packed_sequences(spark.createDataFrame([(0, 1, [5, 6], [-100, 6]), (0, 2, [7], [7])], "b int, k int, ids array<int>, labels array<int>"), spark.createDataFrame([(0, 1, 0, 0), (0, 2, 0, 1)], "b int, k int, bin int, place int"), "b", "k", "ids", "labels", 4, 0).first()
    assert (packed.input_ids, packed.labels, packed.position_ids, packed.segments) == ([5, 6, 7, 0, 0], [-100, 6, 7, -100, -100], [0, 1, 0, 0, 0], [1, 1, 2, 0, 0])


def test_turns_under_one_budget(spark):
    df = spark.sql("select array(array(1, 2), array(3)) p, array(array(4, 5), array(6, 7)) r")
    x = df.select(T.multi_turn("p", "r", 100).alias("a"), T.multi_turn("p", "r", 100, last_only=True).alias("b"), T.multi_turn("p", "r", 3, last_only=True).alias("c")).first()
    assert (x.a.input_ids, x.a.labels) == ([1, 2, 4, 5, 3, 6, 7], [-100, -100, 4, 5, -100, 6, 7])
    assert x.b.labels == [-100, -100, -100, -100, -100, 6, 7]
    assert x.c.input_ids == [3, 6, 7]
    assert T.encoder_for("ranking") is T.pairwise


def test_small_operators(spark):
    from siftwell.functions import vector as V
    from siftwell.operators import groupstats as G
    from siftwell.operators import labels as L

    r = spark.sql("select array(1, 1, 0) m, 2.5D s, array(1D, 3D, 5D) v").select(G.place_score("s", "m").alias("p"), G.last_counted("v", "m").alias("l"), G.running_baseline("v").alias("b"), V.normal_colour(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0))).alias("c")).first()
    assert (r.p, r.l, r.b, r.c) == ([0.0, 2.5, 0.0], 3.0, [0.0, 1.0, 2.0], [0, 127, 255])
    n = G.nan_skipping(spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 2.0)], "k string, x double"), "k", ["x"]).orderBy("k").collect()
    assert [(x.x_sum, x.x_count) for x in n] == [(1.0, 1), (2.0, 1)]
    labels = spark.createDataFrame([("car",), ("auto",), ("junk",)], "label string")
    for reply in ('{"Cars": "car", "auto": "car", "junk": "drop", "new": "x"}', 'so ```json\n{"mapping": {"car": "car", "auto": "car", "junk": "remove"}}\n```', '[{"label": "car", "canonical": "car"}, {"label": "auto", "canonical": "car"}, {"label": "junk", "canonical": "discard"}]'):
        got = L.mapping_from_reply(spark.createDataFrame([(reply,)], "t string"), "t", labels)
        assert sorted((x.label, x.canonical) for x in got.collect()) == [("auto", "car"), ("car", "car"), ("junk", None)]
    a = spark.sql("select array('x', 'y') n, array(array(1D), array(2D)) b, array(3, 4) a, array(0.5D, 0.6D) s").select(L.annotations("n", "b", "a", "s").alias("z")).first().z
    assert [(x.instance_id, x.class_name, x.mask_area) for x in a] == [(1, "x", 3), (2, "y", 4)]
    assert L.vocabulary_json(spark.createDataFrame([("a", 2), ("b", 5)], "label string, support int")).first().labels == '[{"label":"b","support":5},{"label":"a","support":2}]'
