"""Whole-table queries against loops over every row."""

import math

import pytest

from siftwell.operators import groupstats as G
from siftwell.plans import registry

QUERIES = registry.queries()


def series(spark, sf_dir):
    out = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", "value").orderBy("event_id").collect():
        out.setdefault(r.event_type, []).append((r.event_id, r.value))
    return out


def smoothed(values):
    w = 1.8 * (1 / (1 + math.exp(-0.05 * len(values))) - 0.5)
    last, out = values[0], []
    for v in values:
        last = last * w + (1 - w) * v
        out.append(last)
    return out


def test_smoothed_series_of_all_events(spark, sf_dir):
    got = {(r.event_type, r.event_id): r.smoothed for r in QUERIES["smoothed_series"](spark, sf_dir).collect()}
    want = {(t, i): x for t, s in series(spark, sf_dir).items() for (i, _), x in zip(s, smoothed([v for _, v in s]), strict=True)}
    assert len(got) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_smooth_in_blocks(spark, block):
    rows = [(k, i * 7, float((i * i + len(k or "")) % 13)) for k, n in (("a", 10), ("b", 1), ("cc", 6), (None, 4)) for i in range(n)]
    got = {(r.k, r.i): r.smoothed for r in G.smooth(spark.createDataFrame(rows, "k string, i long, v double"), "k", "i", "v", block).collect()}
    want = {(k, i): x for k in {r[0] for r in rows} for (_, i, _), x in zip([r for r in rows if r[0] == k], smoothed([r[2] for r in rows if r[0] == k]), strict=True)}
    assert got == pytest.approx(want)


def test_adaptive_coefficient_of_all_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = {r.event_type: r.coefficient for r in G.adaptive_coefficients(e, "event_type", "value", 0.1, 50.0, 100.0, 10).collect()}
    want = {}
    for t, s in series(spark, sf_dir).items():
        c = 0.1
        for _, v in s:
            c *= 1 + min(max(v / 50 - 1, -0.2), 0.2) * 10 / 100
        want[t] = c
    assert got == pytest.approx(want, rel=1e-9)


def test_masks_of_all_suppliers(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_suppkey AS s", "l_partkey % 4 AS seg").collect():
        want.setdefault(r.s, []).append(r.seg)
    want = {s: sum(a == b != 0 for i, a in enumerate(v) for b in v[: i + 1]) for s, v in ((s, sorted(v)) for s, v in want.items())}
    assert {r.l_suppkey: r.seen for r in QUERIES["block_causal_mask"](spark, sf_dir).collect()} == want


def test_schedule_of_all_events(spark, tmp_path):
    spark.range(0, 3000, 7).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.lr for r in QUERIES["cosine_schedule"](spark, str(tmp_path)).collect()}
    want = {s: 0.1 + 0.9 * s / 100 if s < 100 else math.cos(math.pi * (s - 100) / 900) * 0.45 + 0.55 for s in range(0, 3000, 7)}
    assert got == pytest.approx(want, abs=2e-6)
