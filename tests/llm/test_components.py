import random

import pytest

from siftwell.llm.components import connected_components


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components_match_union_find(spark, kind):
    rng = random.Random(kind)
    if kind == "path":
        ids = list(range(60))
        rng.shuffle(ids)
        edges = list(zip(ids, ids[1:]))
    elif kind == "star":
        edges = [(50, i) for i in range(40)] + [(i, i) for i in range(5)]
    else:
        edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] if kind == "random" else []
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(n, find(n)) for n in list(root) if find(n) != n}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
