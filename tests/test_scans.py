"""Linear scans and range numbering against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import scans as S
from siftwell.operators import batch as B
from siftwell.operators import groupstats as G
from siftwell.operators import mix, tokens


def rows(n=40, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 2, 7, 30])
        out.append((i, [rng.uniform(-2, 2) for _ in range(k)], [rng.uniform(-1, 1) for _ in range(k)], [rng.randrange(2) for _ in range(k)]))
    return [*out, (n, None, None, None)]


def test_recurrences_match_loops(spark):
    data = rows()
    df = spark.createDataFrame(data, "i int, r array<double>, v array<double>, m array<int>")
    got = df.select("i", G.reverse_cumsum("r").alias("c"), G.discounted_returns("r", "m", 0.9).alias("d"), G.generalised_advantage("r", "v", "m", 0.9, 0.8).alias("a"), G.position_ids("m").alias("p"), G.running_baseline("r", 0.5).alias("b"), S.over(S.affine, "array<double>", "r", "v").alias("x")).collect()
    for row in got:
        r, v, m = data[row.i][1:]
        if r is None:
            assert row[1:] == (None,) * 6
            continue
        n = len(r)
        cum, ret, adv = [0.0] * n, [0.0] * n, [0.0] * n
        run = carried = last = after = 0.0
        for t in reversed(range(n)):
            run = cum[t] = run + r[t]
            ret[t] = r[t] + 0.9 * carried
            carried = ret[t] * m[t]
            if m[t]:
                last, after = r[t] + 0.9 * after - v[t] + 0.9 * 0.8 * last, v[t]
            adv[t] = last
        mean, means, x, folded = 0.5, [], 0.0, []
        for t in range(n):
            means.append(mean)
            mean += (r[t] - mean) / (t + 1)
            x = x * r[t] + v[t]
            folded.append(x)
        assert row.c == pytest.approx(cum) and row.d == pytest.approx(ret) and row.a == pytest.approx(adv)
        assert row.p == [max(sum(m[: t + 1]) - 1, 0) for t in range(n)] and row.b == pytest.approx(means) and row.x == pytest.approx(folded)


def test_arrays_of_different_lengths_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1])], "r array<double>, m array<int>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(G.discounted_returns("r", "m", 0.9)).collect()


def test_first_end_token_ends_the_mask(spark):
    df = spark.createDataFrame([([5, 1, 9, 1],), ([5, 6],), ([],), ([9],)], "i array<int>")
    assert [r[0] for r in df.select(G.response_mask("i", [1, 9])).collect()] == [[1, 1, 0, 0], [1, 1], [], [1]]


def test_numbers_and_sums_run_over_partitions(spark):
    data = [(i % 7, (i * 37) % 500, i % 5) for i in range(500)]
    df = spark.createDataFrame(data, "g int, o int, n int").repartition(6)
    assert sorted((r.o, r._pos) for r in B.with_position(df, "o").collect()) == [(i, i) for i in range(500)]
    got = {(r.g, r.o): r.s for r in B.running_before(df, "g", "o", F.col("n").cast("long"), "s").collect()}
    assert got == {(g, o): sum(n for h, p, n in data if h == g and p < o) for g, o, _ in data}


def test_large_heads_are_those_of_the_top(spark, monkeypatch):
    df = spark.range(300).withColumnRenamed("id", "k")
    small = {r.k for r in mix.shuffled_head(df, "k", 120).collect()}
    monkeypatch.setattr(mix, "TOP_ROWS", 10)
    assert {r.k for r in mix.shuffled_head(df, "k", 120).collect()} == small and len(small) == 120
    by = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9)], "g string, v int")
    assert sorted((r.g, r.v) for r in mix.by_rank(by, "g", "v", 2).collect()) == [("a", 2), ("b", 9)]


@pytest.mark.parametrize("size", [1, 4, 7])
def test_blocks_of_uneven_rows(spark, size):
    data = [("x", i, list(range(i * 10, i * 10 + n))) for i, n in enumerate([3, 0, 11, 1, 6])] + [("y", 0, [1, 2]), ("y", 1, [])]
    df = spark.createDataFrame(data, "b string, o int, ids array<int>").repartition(3)
    got = {(r.b, r.block): r.input_ids for r in tokens.pretrain_blocks(df, "b", "o", "ids", size, begin_id=-7).collect()}
    want = {}
    for b in "xy":
        flat = [t for c, _, ids in data if c == b for t in ids]
        for k in range(len(flat) // size):
            want[b, k] = [-7, *flat[k * size + 1 : (k + 1) * size]]
    assert got == want


def test_discounted_logps(spark):
    df = spark.createDataFrame([([0.5, 1.0, 2.0, 4.0, 9.0], [-100, -100, 3, 4, 5])], "p array<double>, l array<int>")
    row = df.select(G.discounted_logps("p", "l", F.lit(2), 0.1).alias("x"), G.masked_logps("p", "l").alias("all"), G.counted_labels("l").alias("n")).first()
    # labels 3, 4, 5 meet the log probabilities 1, 2, 4; the first two are public
    assert (row.x, row["all"], row.n) == (pytest.approx(1.0 + 2.0 + 0.1 * 4.0), 7.0, 3)
