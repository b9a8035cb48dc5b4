"""Number partitioning against a plain statement of the rule."""

import random

from pyspark.sql import functions as F

from siftwell.operators import tokens as T


def plain_differencing(lengths, parts):
    """The two states of the widest spread merge, the largest set of one with the smallest of the other, till one is left."""
    states = [[([], 0)] * (parts - 1) + [([i], n)] for i, n in enumerate(lengths)]
    key = lambda s: max(x[1] for x in s) - min(x[1] for x in s)
    while len(states) > 1:
        states.sort(key=key)
        a, b = states.pop(), states.pop()
        a, b = sorted(a, key=lambda x: x[1]), sorted(b, key=lambda x: -x[1])
        states.append([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b, strict=True)])
    return sorted(x[1] for x in states[0])


def test_differencing_without_ties():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 100_000), rng.randint(1, 12))  # far apart, so that spreads hardly tie
        parts = rng.randint(1, 5)
        made = T.differencing(lengths, parts)
        assert len(made) == parts and sorted(i for s in made for i in s) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in s) for s in made) == plain_differencing(lengths, parts)


def test_micro_batches_by_the_rule(spark):
    rng = random.Random(5)
    rows = [(b, k, n) for b in range(8) for k, n in enumerate(rng.sample(range(1, 9000), rng.randint(1, 12)))]
    got = T.micro_batches(spark.createDataFrame(rows, "b int, k int, n int"), "b", "k", "n", 9000)
    by = {}
    for r in got.collect():
        by.setdefault(r.b, {}).setdefault(r.part, []).append(r.k)
    for b in range(8):
        lengths = [n for x, _, n in rows if x == b]
        k = max(1, min(len(lengths), -(-sum(lengths) // 9000)))
        sums = [sum(lengths[i] for i in by[b].get(p, [])) for p in range(k)]
        assert sorted(sums) == plain_differencing(lengths, k) and sorted(i for s in by[b].values() for i in s) == list(range(len(lengths)))
        squares = [sum(lengths[i] ** 2 for i in by[b].get(p, [])) for p in range(k)]
        assert squares == sorted(squares, reverse=True)


def test_registered_partitions(spark, sf_dir):
    from siftwell.plans import registry

    for name in ("differencing_partitions", "micro_batches"):
        df = registry.queries()[name](spark, sf_dir)
        assert df.count() > 0 and df.where(F.col(df.columns[0]).isNull()).count() == 0
