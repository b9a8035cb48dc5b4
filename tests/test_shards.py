"""Sequence shards, interleaving rules and held bytes on edge cases."""

from pyspark.sql import functions as F

from siftwell.operators import batch as B
from siftwell.operators import mix as M
from siftwell.operators import tokens as T


def test_shards_round_trip(spark):
    rows = [(i, list(range(i)), [float(x) for x in range(i)], list(range(100, 100 + i))) for i in (0, 1, 3, 4, 9)] + [(7, None, None, None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>, w array<double>, labels array<int>")
    parts = T.sequence_shards(df, {"ids": 0, "w": 0.5, "labels": -100}, 4, "labels")
    assert parts.count() == 4 * len(rows)
    by = {}
    for r in parts.collect():
        by.setdefault(r.k, {})[r.rank] = r
    assert [by[9][i]["ids"] for i in range(4)] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [0, 0, 0]]
    # the last token of a part is asked for the first of the next
    assert [by[9][i].labels for i in range(4)] == [[101, 102, 103], [104, 105, 106], [107, 108, -100], [-100] * 3]
    assert by[4][3].w == [3.0] and by[0][2]["ids"] == [] and by[7][1]["ids"] == [] and by[3][0].padding == 1
    back = {r.k: (r["ids"], r.w) for r in T.gathered_shards(parts, ["k"], ["ids", "w"]).collect()}
    assert back == {k: (ids or [], w or []) for k, ids, w, _ in rows}


def test_draws_end_as_told(spark):
    def frame(n):
        return spark.range(n).select("id")

    def draws(sizes, shares, **options):
        rows = M.interleave_by_probability([frame(n) for n in sizes], "id", shares, **options).orderBy("_at").collect()
        assert [r._at for r in rows] == list(range(len(rows)))
        return [(r._source, r.id) for r in rows]

    for stop in ("first", "all"):
        got = draws((5, 40, 3), (0.5, 0.3, 0.2), stop=stop)
        counts = [sum(s == k for s, _ in got) for k in range(3)]
        full = [c >= n for c, n in zip(counts, (5, 40, 3))]
        assert any(full) if stop == "first" else all(full)
        before = [sum(s == k for s, _ in got[:-1]) for k in range(3)]
        assert not any(c >= n for c, n in zip(before, (5, 40, 3))) if stop == "first" else not all(c >= n for c, n in zip(before, (5, 40, 3)))
        seen = [0, 0, 0]
        for s, i in got:  # rows come in order, again from the start
            assert i == seen[s] % (5, 40, 3)[s]
            seen[s] += 1
    assert draws((0, 4), (0.5, 0.5)) == [] and {s for s, _ in draws((0, 4), (0.5, 0.5), stop="all")} == {1}
    assert {s for s, _ in draws((3, 4), (0.0, 1.0), stop="all")} == {1}


def test_bytes_of_nested_values(spark):
    df = spark.createDataFrame([([1, 2], "aé", {"k": [1.0]}, (True, None)), (None, None, None, None)], "a array<int>, s string, m map<string, array<double>>, t struct<b: boolean, c: string>")
    assert {r.column: r.bytes for r in B.held_bytes(df).collect()} == {"a": 8, "s": 3, "m": 9, "t": 1}
    assert {r.bytes for r in B.held_bytes(df.limit(0)).collect()} == {0}
    assert B.held_bytes(spark.range(3).select(F.col("id").alias("a b"))).first().bytes == 24
