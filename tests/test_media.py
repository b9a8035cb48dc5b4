import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import points as P
from siftwell.functions import vector as V
from siftwell.operators import dispatch as D
from siftwell.operators import geometry as G
from siftwell.operators import media as M
from siftwell.operators import overlap as O
from siftwell.operators import scoring as S


def test_point_goldens(spark):
    cases = {
        '[{"point_2d": [[100, 200]], "label": "eye"}]': [[100, 200]],
        '<point x="63.5" y="44.5">Mountain</point><point x="63.8" y="44.5">Mountain</point>': [[63.5, 44.5], [63.8, 44.5]],
        "```json\n[[10, 20], [30, 40]]\n```": [[10, 20], [30, 40]],
        "The center is at (500, 500) and (789, 1000).": [[500, 500], [789, 1000]],
        "<points>[123, 456]</points>": [[123, 456]],
        "<points>[[122, 333], [222, 333]]</points>": [[122, 333], [222, 333]],
        "point: 12.5, 13.5": [[12.5, 13.5]],
        "": [],
        "nothing": [],
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").withColumn("p", P.decode_points("t"))
    got = {r.t: r.p for r in df.collect()}
    assert got == {**cases, None: []}


def test_written_points():
    """A value alone counts by its keys; in running text each bracketed pair does, else each two numbers."""
    cases = {
        "[[1,2],[3,4]]": [[1, 2], [3, 4]], "[(1.5, 2), (3, -4)]": [[1.5, 2], [3, -4]], '{"bbox": [9, 9], "point": [1, 2]}': [[1, 2]], '{"points": [[5,6]], "point_2d": [1,2]}': [[1, 2]],
        '{"bbox": [9, 9]}': [[9, 9]], "Answer: [3, 4]": [[3, 4]], "1, 2, 3, 4": [[1, 2], [3, 4]], "[1,2,3]": [[1, 2]], 'see (10, 20) and {"point": [3, 4]}': [[10, 20], [3, 4]],
        "<points>[1,2],[3,4]</points>": [[1, 2], [3, 4]], "x <point>[1,2]</point> [5,6]": [[1, 2]], '[{"point_2d": [1, 2], "label": "a, [3, 4]"}]': [[1, 2]],
        "[{'point_2d': [1, 2]}, {'coordinates': [3, 4]}]": [[1, 2], [3, 4]], "[1, 2": [[1, 2]], "[[[1, 2]], [3, 4]]": [[1, 2], [3, 4]], "1,2,3": [[1, 2]], '["a", 1, 2]': [[1, 2]], "a1,2": [[1, 2]],
        "[" * 5000: [], "]": [], '{"point": {"point": [1, 2]}}': [[1, 2]],
    }
    for text, points in cases.items():
        assert P.written_points(text) == points, text


def test_points_in_masks_and_boxes(spark):
    mask = np.zeros((4, 5), np.uint8)
    mask[1, 2] = 9
    df = spark.createDataFrame([([[2.4, 1.4], [0.0, 0.0], [99.0, 1.0]], bytearray(mask.tobytes()), 5, [0.0, 0.0, 2.0, 1.0])], "p array<array<double>>, m binary, w int, b array<double>")
    r = df.select(P.count_in_mask("p", "m", "w").alias("m"), P.count_in_box(F.col("p"), F.col("b")).alias("b"), P.masks_covered("p", F.array("m", "m"), "w").alias("c"), P.to_pixel(F.array(F.lit(500.0), F.lit(1000.0)), F.lit(11), F.lit(21)).alias("x")).first()
    assert (r.m.inside, r.m.total, r.b.inside, r.c.covered, r.c.total, r.x) == (1, 3, 2, 2, 2, [5, 20])


def test_shapes(spark):
    sq = F.array(*(F.array(*(F.lit(float(v)) for v in p)) for p in ((0, 0), (4, 0), (4, 4), (0, 4))))
    pts = [((2, 2), True), ((5, 2), False), ((4, 4), True), ((0, 0), False), ((-1, 2), False)]
    row = spark.range(1).select(*(V.in_polygon(F.array(*(F.lit(float(v)) for v in p)), sq).alias(f"c{i}") for i, (p, _) in enumerate(pts))).first()
    assert list(row) == [w for _, w in pts]
    t = F.array(*(F.array(F.lit(float(x)), F.lit(0.0)) for x in (0, 10)))
    assert spark.range(1).select(V.resampled(t, F.lit(5)).alias("r")).first().r == [[0, 0], [2.5, 0], [5, 0], [7.5, 0], [10, 0]]


def test_task_scores(spark):
    df = spark.createDataFrame([('[{"point_2d": [0, 0]}, {"point_2d": [100, 0]}]', '[{"point_2d": [0, 0]}, {"point_2d": [100, 0]}]'), ('[{"point_2d": [0, 85]}, {"point_2d": [100, 85]}]', '[{"point_2d": [0, 0]}, {"point_2d": [100, 0]}]'), ("bad", "[]")], "a string, t string")
    one = lambda d, kind, a="a", t="t": [r.s.accuracy for r in S.score_rows(d.withColumn("kind", F.lit(kind)), a, t, "kind", relaxed=True, out="s").collect()]
    assert one(df, "trace") == [1.0, pytest.approx(0.5), 0.0]
    box = spark.createDataFrame([('[{"bbox_2d": [0, 0, 10, 10]}]', '{"bbox_2d": [0, 0, 10, 20]}')], "a string, t string")
    assert one(box, "spatial grounding") == [pytest.approx(0.5)]
    reg = spark.createDataFrame([('[{"point_2d": [5, 5]}, {"point_2d": [50, 5]}]', '[{"bbox_2d": [0, 0, 10, 10]}]', '[{"polygon": [[0, 0], [10, 0], [10, 10], [0, 10]]}]')], "a string, b string, p string")
    assert one(reg, "point", "a", "b") == one(reg, "point", "a", "p") == [0.5]
    three = spark.createDataFrame([('[{"point_2d": [0, 0], "depth": 1.0}, {"point_2d": [9, 0], "depth": 2.0}]', '[{"point_2d": [0, 0], "depth": 1.25}, {"point_2d": [9, 0], "depth": 2.25}]')], "a string, t string")
    assert one(three, "trace_3d") == [pytest.approx(0.75)]
    assert O.bleu("a b c d".split(), "a b c d".split()) == pytest.approx(1.0)
    assert O.rouge_l("a b c".split(), "a c".split()) == pytest.approx(0.8)
    n = spark.createDataFrame([("1,000.04", "1000"), ("x", "1"), ("2.25", "2.2")], "a string, t string")
    assert [r.s for r in n.select(S.numeric_score(F.col("a"), F.col("t")).alias("s")).collect()] == [1.0, 0.0, 1.0]


def test_kinds_of_rows(spark):
    track = '[{"point_2d": [%d, %d], "depth": %s}, {"point_2d": [100, 0], "depth": 2.0}]'
    cases = [
        ("trace", track % (0, 60, 1), track % (0, 0, 1), 1 - (60 / 2**0.5 - 50) / 70 if 60 / 2**0.5 > 50 else 1.0),
        ("trace_3d", track % (0, 60, 1.2), track % (0, 0, 1), 1.0),
        ("point", '[{"point_2d": [5, 5]}]', '[{"point_2d": [5, 90]}]', 1 - (85 - 40) / 110),
        ("spatial grounding", '[{"bbox_2d": [0, 0, 4, 4]}]', '[{"bbox_2d": [0, 0, 4, 8]}]', 0.5),
        ("numerical", "1.04", "1.0", 1.0),
        ("Multiple Choice", "B) x", "B", 1.0),
        ("math", "\\frac{4}{8}", "0.5", 1.0),
        ("math", "x+1", "x-1", 0.0),
        ("unknown", "a", "a", 0.0),
    ]
    rows = [(i, k, f"<answer>{a}</answer>", t, w) for i, (k, a, t, w) in enumerate(cases)] + [(99, "math", None, "1", 0.0), (100, None, "<answer>a</answer>", "a", 0.0)]
    df = spark.createDataFrame(rows, "i int, kind string, r string, t string, w double")
    for relaxed in (False, True):
        for x in S.score_rows(df, "r", "t", "kind", relaxed=relaxed, out="s").collect():
            assert x.s.accuracy == pytest.approx(x.w), x


def test_frames_and_positions(spark):
    r = spark.range(1).select(M.frame_count(F.lit(100), F.lit(25.0)).alias("n"), M.frame_range(F.lit(100), F.lit(25.0), F.lit(1.0), F.lit(2.0)).alias("r"), M.evenly(F.lit(0), F.lit(9), F.lit(4)).alias("e"), M.target_size(F.lit(100), F.lit(50), 14).alias("s"), M.timed_video(F.lit("a<video>b"), F.array(F.lit(2), F.lit(4), F.lit(4)), F.array(F.lit(0.5), F.lit(1.0)), token="#", start="[", stop="]").alias("t")).first()
    assert (r.n, tuple(r.r), r.e, tuple(r.s)) == (8, (25, 50, 26), [0, 3, 6, 9], (112, 56)) and r.t == "a<0.5 seconds>[####]<1.0 seconds>[####]b"
    p = spark.sql("select array(0, 1, 1, 1, 1, 0) k, array(array(1, 2, 2)) g").select(M.rope_positions("k", "g").alias("p")).first().p
    assert [tuple(x) for x in p] == [(0, 0, 0), (1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (3, 3, 3)]
    c = spark.range(1).select(M.split_placeholders(F.lit("a<image>b<image>"), "<image>", "image").alias("c")).first().c
    assert [x.type for x in c] == ["text", "image", "text", "image"]


def test_world_frame_and_normals(spark):
    m = np.array(G.world_frame((0.0, -1.0, 0.0), (1.0, 2.0, 3.0)))
    assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3)) and np.allclose(m @ [1, 2, 3, 1], [0, 0, 0, 1]) and np.allclose(m[2, :3], [0, -1, 0])
    rng = np.random.default_rng(0)
    n = np.concatenate([rng.normal((0, -1, 0), 0.02, (80, 3)), rng.normal(size=(20, 3))])
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(n)], "image_id int, point_id long, nx double, ny double, nz double")
    r = G.dominant_normal(df).first()
    assert r.ny < -0.99 and r.inliers >= 75
    pts = spark.createDataFrame([(1, i, float(i % 10), float(i // 10), 0.0, i % 3, 1) for i in range(100)], "image_id int, point_id long, x double, y double, z double, class_id int, instance_id int")
    assert abs(G.voxels_to_target(pts, 25).count() - 25) <= 8
    long = spark.createDataFrame([(1, i, float(i) / 10, float(i % 5), 0.0, 1, 1) for i in range(400)], "image_id int, point_id long, x double, y double, z double, class_id int, instance_id int")
    b = G.principal_boxes(long, ["image_id"]).first()
    assert sorted(b.size) == pytest.approx([0, 4, 39.9], abs=0.1)  # the axes of a long thin grid are its own
    px = spark.createDataFrame([(1, u, v, 1.0 if u < 4 else 3.0) for u in range(8) for v in range(4)], "image_id int, u int, v int, depth double")
    e = {(r.u, r.v) for r in G.edge_mask(px).where("edge").collect()}
    assert (3, 1) in e and (4, 1) in e and (0, 0) not in e
    o = G.plane_origin(pts.withColumn("z", F.when(F.col("x") > 8, 5.0).otherwise(0.01)), (0.0, 0.0, 1.0)).first()
    assert o.z == pytest.approx(0.01)
    colours = G.instance_colours(spark.createDataFrame([(0,), (3,), (5,)], "i int"), "i").orderBy("i").collect()
    assert [tuple(c) for c in colours] == [(3, 255, 0, 0), (5, 0, 255, 255)]


def test_dispatch(spark):
    df = spark.range(12).withColumn("v", F.col("id") * 2)
    assert D.dispatch(df, "id", 4, lambda p: p.agg(F.sum("v").alias("s"))).count() == 4
    assert sorted(r.s for r in D.ship(df, "id", 4, lambda p: p.agg({"v": "sum"}).to_frame().T.rename(columns={"v": "s"}), "s long").collect()) == [6, 24, 42, 60]
    assert D.dispatch(df, "id", 3, lambda p: p, "one_to_all").count() == 12
    with pytest.raises(ValueError):
        D.in_chunks(df, "id", 5)
    assert D.once_per_key(df.withColumn("k", F.col("id") % 3), "k", ["v"], lambda d: d.withColumn("w", F.col("v") + 1)).count() == 12
    assert D.map_batches(df, lambda p: p[p["v"] > 10], "id long, v long").count() == 6
