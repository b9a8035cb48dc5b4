"""Scene operators that spread one image over tasks give what a plain pass over the whole image gives."""

import numpy as np
import pytest

from siftwell.operators import geometry as G


def plain_edges(depth, thickness, tolerance):
    h, w = depth.shape
    ok = np.isfinite(depth) & (depth > 0)
    disp = np.where(ok, 1 / np.where(ok, depth, 1), 0.0)

    def near(v, u, r):
        return [(y, x) for y in range(max(v - r, 0), min(v + r + 1, h)) for x in range(max(u - r, 0), min(u + r + 1, w))]

    flags = np.zeros((2, h, w), bool)
    for v in range(h):
        for u in range(w):
            if ok[v, u]:
                around = [disp[q] for q in near(v, u, 1) if ok[q]]
                mean = sum(around) / len(around)
                flags[0, v, u], flags[1, v, u] = disp[v, u] > mean * (1 + tolerance), disp[v, u] < mean * (1 - tolerance)
    return {(v, u): all(any(f[q] for q in near(v, u, thickness)) for f in flags) for v in range(h) for u in range(w)}


@pytest.mark.parametrize("thickness", [1, 2])
def test_edges_in_tiles(spark, thickness):
    rng = np.random.default_rng(1)
    depth = np.where(rng.random((23, 31)) < 0.1, np.nan, 1 + (np.add.outer(np.arange(23), np.arange(31)) // 7 % 3))
    rows = [(7, u, v, float(depth[v, u]), "x") for v in range(23) for u in range(31)]
    df = spark.createDataFrame(rows, "image_id int, u int, v int, depth double, note string").repartition(4)
    want = plain_edges(depth, thickness, 0.05)
    for tile in (8, 1024):
        got = G.edge_mask(df, thickness=thickness, tile=tile).collect()
        assert len(got) == len(rows) and {(r.v, r.u): r.edge for r in got} == want
    assert any(want.values())


def test_votes_in_shares(spark):
    rng = np.random.default_rng(3)
    n = np.concatenate([rng.normal((0.2, -1, 0.1), 0.03, (600, 3)), rng.normal(size=(400, 3)) * 5])
    rows = [(1, i, *map(float, v)) for i, v in enumerate(n)] + [(2, 0, 0.0, 1.0, 0.0), (2, 1, 0.0, 2.0, 0.01), (None, 5, 1.0, -1.0, 0.0)]
    df = spark.createDataFrame(rows, "image_id int, point_id long, nx double, ny double, nz double").repartition(6)
    unit = n / np.linalg.norm(n, axis=1, keepdims=True)
    cos = np.cos(np.radians(10))
    most = max(int((unit @ c > cos).sum()) for c in unit[unit[:, 1] < 0])
    whole = {r.image_id: tuple(r) for r in G.dominant_normal(df, iterations=1000).collect()}
    shared = {r.image_id: tuple(r) for r in G.dominant_normal(df, iterations=1000, share=37).collect()}
    assert whole.keys() == shared.keys() == {1, 2, None}
    assert all(a[-1] == b[-1] and np.allclose(a[1:4], b[1:4]) for a, b in ((whole[k], shared[k]) for k in whole))
    assert whole[1][-1] == most  # every upward normal was a candidate
    assert np.isclose(np.linalg.norm(whole[1][1:4]), 1, atol=1e-6) and whole[1][2] < -0.9
    assert whole[2][2] < -0.99 and whole[2][-1] == 2  # none points up, so all are candidates and the mean is turned
    assert G.dominant_normal(df.limit(0)).count() == 0


def test_boxes_of_moments(spark):
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    clouds = {("a", 1): rng.uniform(-1, 1, (900, 3)) * (9, 4, 1) @ turn.T + (5, 6, 7), ("a", 2): np.array([[1.0, 2, 3], [4, 2, 3]]), (None, 3): np.array([[1.0, 1, 1]])}
    rows = [(k, j, *map(float, v)) for (k, j), ps in clouds.items() for v in ps]
    got = {(r.k, r.j): r for r in G.principal_boxes(spark.createDataFrame(rows, "k string, j int, x double, y double, z double").repartition(5), ["k", "j"]).collect()}
    assert got.keys() == clouds.keys()
    for key, p in clouds.items():
        centre = p.mean(0)
        axes = np.linalg.svd(p - centre)[2] if len(p) >= 3 else np.eye(3)  # singular vectors: another way to the same axes
        local = (p - centre) @ axes.T
        assert np.allclose(got[key].centre, centre) and np.allclose(got[key].size, local.max(0) - local.min(0)), key
        assert np.allclose(np.abs(np.array(got[key].axes).reshape(3, 3) @ axes.T), np.eye(3), atol=1e-6)
