"""The moving average over series of any length, in blocks of blocks, against a plain loop."""

import math

import numpy as np
import pytest

from siftwell.operators import groupstats as G


@pytest.mark.parametrize(("block", "fan"), [(3, 4), (512, 512)])
def test_blocks_of_blocks(spark, block, fan):
    rng = np.random.default_rng(block)
    series = {"a": rng.normal(size=70), "b": rng.normal(size=1), None: rng.normal(size=5), "c": rng.normal(size=4)}
    rows = [(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    got = {(r.k, r.i): r.smoothed for r in G.smooth(spark.createDataFrame(rows, "k string, i int, v double").repartition(5), "k", "i", "v", block, fan).collect()}
    assert len(got) == len(rows)
    for k, vs in series.items():
        w, x = 1.8 * (1 / (1 + math.exp(-0.05 * len(vs))) - 0.5), vs[0]
        for i, v in enumerate(vs):
            x = x * w + (1 - w) * v
            assert got[k, i] == pytest.approx(x, rel=1e-12, abs=1e-12)


def test_no_rows(spark):
    assert G.smooth(spark.createDataFrame([], "k string, i int, v double"), "k", "i", "v").count() == 0
