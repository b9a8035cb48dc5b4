"""Point clouds and scenes: back-projection, voxels, planes, world frames, boxes, packages.

Points are rows with x, y, z (camera frame: y down) and an image column; images are independent,
so every operator groups by image and big images split only by map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.batch import with_position
from siftwell.sources.scratch import materialise

AXES = ("x", "y", "z")


def valid_depth(depth: Column) -> Column:
    return depth.isNotNull() & ~F.isnan(depth) & (F.abs(depth) != float("inf")) & (depth > 0)


def backproject(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """x, y, z of every pixel (u, v, depth) with intrinsics given as shares of width and height."""
    d = F.col("depth").cast("double")
    rows = pixels.where(valid_depth(F.col("depth")))
    return rows.withColumn("x", (F.col("u") - cx * width) * d / (fx * width)).withColumn("y", (F.col("v") - cy * height) * d / (fy * height)).withColumn("z", d)


#: Pixels a side of a tile, and points of one image that one task takes.
TILE, SHARE = 1024, 100_000


def _boxed(a: np.ndarray) -> np.ndarray:
    """Sum over the 3x3 neighbourhood."""
    p = np.pad(a, 1)
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3))


def edge_mask(pixels: DataFrame, image: str = "image_id", thickness: int = 1, tolerance: float = 0.05, tile: int = TILE) -> DataFrame:
    """Adds edge: pixels where both near and far neighbours lie within ``thickness`` steps.

    A pixel is in front of (behind) its surroundings if its disparity exceeds (falls short of) the
    mean of the valid 3x3 neighbourhood by the tolerance; both flags are dilated and must meet.
    Images are worked on in tiles with a margin as wide as a flag can reach, so one of any size is spread over tasks.
    """
    margin = thickness + 1
    kinds = dict(pixels.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, top = int(pdf["_x"].iloc[0]) * tile - margin, int(pdf["_y"].iloc[0]) * tile - margin
        u, v = pdf["u"].to_numpy(np.int64) - left, pdf["v"].to_numpy(np.int64) - top
        disp, ok = np.zeros((v.max() + 1, u.max() + 1)), np.zeros((v.max() + 1, u.max() + 1), bool)
        depth = pdf["depth"].to_numpy(float)
        good = np.isfinite(depth) & (depth > 0)
        disp[v[good], u[good]] = 1 / depth[good]
        ok[v[good], u[good]] = True
        mean = _boxed(disp) / np.maximum(_boxed(ok.astype(float)), 1)
        front, back = ok & (disp > mean * (1 + tolerance)), ok & (disp < mean * (1 - tolerance))
        for _ in range(thickness):
            front, back = _boxed(front.astype(float)) > 0, _boxed(back.astype(float)) > 0
        own = (u >= margin) & (u < margin + tile) & (v >= margin) & (v < margin + tile)
        return pdf[own].drop(columns=["_x", "_y"]).assign(edge=(front & back)[v[own], u[own]])

    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-margin), F.lit(0), F.lit(margin)), lambda d: F.floor((F.col(c) + d) / tile)))
    spread = pixels.withColumn("_x", F.explode(near("u"))).withColumn("_y", F.explode(near("v")))
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", edge boolean"
    return spread.groupBy(image, "_x", "_y").applyInPandas(run, schema)


def voxels(points: DataFrame, size: float, image: str = "image_id", order: str = "point_id") -> DataFrame:
    """One point per voxel: mean place, mean colour (truncated), mean unit normal, class and instance of the first point."""
    keys = [F.floor(F.col(a) / size).alias(f"v{a}") for a in AXES]
    first = F.min(F.struct(order, "class_id", "instance_id"))
    aggs = [*(F.avg(a).alias(a) for a in AXES), first.alias("_f"), F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(c) for c in ("red", "green", "blue", "nx", "ny", "nz") if c in points.columns]
    out = points.groupBy(image, *keys).agg(*aggs).withColumn("class_id", F.col("_f.class_id")).withColumn("instance_id", F.col("_f.instance_id")).drop("_f")
    for c in ("red", "green", "blue"):
        if c in points.columns:
            out = out.withColumn(c, F.col(c).cast("int"))
    if "nx" in points.columns:
        n = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) + 1e-8
        out = out.withColumn("_n", n)
        for c in ("nx", "ny", "nz"):
            out = out.withColumn(c, F.col(c) / F.col("_n"))
        out = out.drop("_n")
    return out


def voxels_to_target(points: DataFrame, target: int, image: str = "image_id", order: str = "point_id", rounds: int = 12) -> DataFrame:
    """Voxels whose size is searched until their number is within a tenth of the target.  points hold one image."""
    n = points.count()
    if target <= 0 or n <= target:
        return points
    spread = points.agg(*((F.max(a) - F.min(a)).alias(a) for a in AXES)).first()
    size = max(max(spread) / target ** (1 / 3), 1e-6)
    out = voxels(points, size, image, order)
    for i in range(rounds):
        out = voxels(points, size, image, order)
        got = out.count()
        if abs(got - target) <= max(1, int(0.1 * target)) or i == rounds - 1:
            break
        size = size * 1.2 if got > target else size / 1.2
    return out


def boxes(points: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Per instance: number of points, centroid, least and largest corner, side lengths."""
    g = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_points"), *(f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))))
    lengths = [F.round(F.col(f"max_{a}") - F.col(f"min_{a}"), digits).alias(f"length_{a}") for a in AXES]
    return g.select(*keys, "num_points", *(F.round(f"{n}_{a}", digits).alias(f"{n}_{a}") for n in ("mean", "min", "max") for a in AXES), *lengths)


def extents(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Room extents: mean, least, largest, side lengths and floor area; zeros when there are no points."""
    g = points.groupBy(*keys).agg(*(F.coalesce(f(a), F.lit(0.0)).alias(f"{n}_{a}") for a in AXES for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))))
    for a in AXES:
        g = g.withColumn(f"extent_{a}", F.col(f"max_{a}") - F.col(f"min_{a}"))
    return g.withColumn("area", F.col("extent_x") * F.col("extent_y"))


def instance_colours(instances: DataFrame, instance: str) -> DataFrame:
    """Colours of non-zero instances: hue by rank, full saturation and value, components truncated."""
    rows = with_position(instances.where(F.col(instance) != 0).select(instance).distinct(), instance, name="_rank")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    h = (F.col("_rank") / F.col("_n")) * 6.0
    sector, f = F.floor(F.col("_h")).cast("int"), F.col("_h") - F.floor("_h")
    rows = rows.withColumn("_h", h)
    pick = lambda values: F.when(sector == 0, values[0]).when(sector == 1, values[1]).when(sector == 2, values[2]).when(sector == 3, values[3]).when(sector == 4, values[4]).otherwise(values[5])
    one, zero, up, down = F.lit(1.0), F.lit(0.0), f, 1 - f
    r, g, b = pick([one, down, zero, zero, up, one]), pick([up, one, one, down, zero, zero]), pick([zero, zero, up, one, one, down])
    return rows.select(instance, *((c * 255).cast("int").alias(name) for c, name in ((r, "red"), (g, "green"), (b, "blue"))))


def recolour(points: DataFrame, colours: DataFrame, instance: str, default: int = 77) -> DataFrame:
    """Points in their instance's colour; points without one are grey."""
    c = colours.select(F.col(instance).alias("_i"), *(F.col(x).alias(f"_{x}") for x in ("red", "green", "blue")))
    rows = points.join(c, F.col(instance) == F.col("_i"), "left")
    for x in ("red", "green", "blue"):
        rows = rows.withColumn(x, F.coalesce(f"_{x}", F.lit(default)))
    return rows.drop("_i", "_red", "_green", "_blue")


def plane_height(points: DataFrame, normal: Sequence[float], keys: Sequence[str] = (), bins: int = 500) -> DataFrame:
    """Centre of the first fullest of ``bins`` equal bins of the projections on a normal."""
    p = points.withColumn("p", sum((F.col(a) * n for a, n in zip(AXES, normal, strict=True)), F.lit(0.0)))
    span = p.groupBy(*keys).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    rows = p.join(span, list(keys)) if keys else p.crossJoin(F.broadcast(span))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("p") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(*keys, "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys, "lo", "hi").agg(F.min(F.struct((-F.col("n")).alias("n"), "bin")).alias("s"))
    return best.select(*keys, (F.col("lo") + (F.col("s.bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("height"))


def plane_origin(points: DataFrame, normal: Sequence[float], keys: Sequence[str] = (), bins: int = 500, threshold: float = 0.03) -> DataFrame:
    """Mean of the points whose projection lies within the threshold of the fullest bin's centre."""
    h = plane_height(points, normal, keys, bins)
    p = points.withColumn("p", sum((F.col(a) * n for a, n in zip(AXES, normal, strict=True)), F.lit(0.0)))
    rows = p.join(h, list(keys)) if keys else p.crossJoin(F.broadcast(h))
    return rows.where(F.abs(F.col("p") - F.col("height")) < threshold).groupBy(*keys).agg(*(F.avg(a).alias(a) for a in AXES))


def dominant_normal(points: DataFrame, image: str = "image_id", iterations: int = 200, degrees: float = 10.0, seed: int = 42, share: int = SHARE) -> DataFrame:
    """Per image the direction that most unit normals agree with, by seeded sampling consensus.

    Candidates are the ``iterations`` upward normals (all, if there are none) of the smallest hashes; each share of an image
    counts the votes for all of them, the counts are summed, and the mean of the winner's voters is
    returned, upward.  Ties go to the smaller hash.
    """
    cos = float(np.cos(np.radians(degrees)))
    names = ["nx", "ny", "nz"]
    size = F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))) + 1e-8
    unit = points.select(image, "point_id", *(F.col(n).cast("double").alias(n) for n in names)).select(image, F.xxhash64(F.lit(seed), "point_id", *names).alias("h"), *((F.col(n) / size).alias(n) for n in names))
    counts = unit.groupBy(F.col(image).alias("_i")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ny") < 0, 1)).alias("up"))
    counts = materialise(counts, "counts")
    on = F.col(image).eqNullSafe(F.col("_i"))
    # some times as many rows as wanted pass the hash; the window then sorts few rows of an image
    chance = F.lit(4.0 * iterations) / F.when(F.col("up") > 0, F.col("up")).otherwise(F.col("n"))
    lot = (F.shiftrightunsigned("h", 11) / float(1 << 53)) < chance
    some = unit.join(counts, on).where(((F.col("up") == 0) | (F.col("ny") < 0)) & lot)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy(image).orderBy("h", *names))).where(F.col("k") <= iterations).select(image, "k", *names)
    some = materialise(some, "candidates")
    spread = unit.join(counts, on).select(image, *names, F.pmod("h", F.ceil(F.col("n") / share)).alias("part"))
    shared = some.join(counts, on).select(image, "k", *names, F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / share) - 1)).alias("part"))

    def vote(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(c):
            return pd.DataFrame({image: [], "k": [], "votes": []})
        hits = (p[names].to_numpy() @ c[names].to_numpy().T > cos).sum(0)
        return pd.DataFrame({image: [c[image].iloc[0]] * len(c), "k": c["k"], "votes": hits})

    kind = dict(points.dtypes)[image]
    votes = spread.groupBy(image, "part").cogroup(shared.groupBy(image, "part")).applyInPandas(vote, f"`{image}` {kind}, k int, votes long")
    best = votes.groupBy(image, "k").agg(F.sum("votes").alias("votes")).groupBy(F.col(image).alias("_w")).agg(F.min(F.struct((-F.col("votes")).alias("less"), "k")).alias("b"))
    winner = best.join(some, F.col("_w").eqNullSafe(F.col(image)) & (F.col("b.k") == F.col("k"))).select("_w", (-F.col("b.less")).cast("int").alias("inliers"), *(F.col(n).alias(f"w{n}") for n in names))
    dot = sum((F.col(n) * F.col(f"w{n}") for n in names), F.lit(0.0))
    mean = unit.join(winner, F.col(image).eqNullSafe(F.col("_w"))).where(dot > cos).groupBy(image, "inliers").agg(*(F.avg(n).alias(n) for n in names))
    length = (F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))) + 1e-8) * F.when(F.col("ny") > 0, -1.0).otherwise(1.0)
    return mean.select(image, *((F.col(n) / length).alias(n) for n in names), "inliers")


def world_frame(normal: Sequence[float], origin: Sequence[float]) -> list[list[float]]:
    """4x4 matrix: z along the normal, x as near to (1, 0, 0) as that allows, the origin at zero."""
    z = np.array(normal, float)
    z = z / np.linalg.norm(z)
    x = np.array([1.0, 0.0, 0.0]) - z[0] * z
    if np.linalg.norm(x) < 1e-6:
        x = np.array([0.0, 1.0, 0.0]) - z[1] * z
    x = x / np.linalg.norm(x)
    r = np.stack([x, np.cross(z, x), z])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, -r @ np.array(origin, float)
    return m.tolist()


def transform(points: DataFrame, matrix: Sequence[Sequence[float]], normals: bool = False) -> DataFrame:
    """Affine image of the places; normals are only rotated."""
    out = points
    new = [sum((F.col(a) * matrix[i][j] for j, a in enumerate(AXES)), F.lit(matrix[i][3])) for i in range(3)]
    cols = {a: c for a, c in zip(AXES, new, strict=True)}
    if normals:
        cols |= {f"n{a}": sum((F.col(f"n{b}") * matrix[i][j] for j, b in enumerate(AXES)), F.lit(0.0)) for i, a in enumerate(AXES)}
    return out.withColumns(cols)


def principal_boxes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Oriented boxes: eigenvectors of the covariance (the largest first), extents along them; under three points an axis box.

    Moments and extents are aggregations, so a group of any size meets map-side; only its 3x3 matrix is solved in Python.
    """
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    inner = [f"_k{i}" for i in range(len(keys))]
    p = points.select(*(F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)), *(F.col(a).cast("double").alias(a) for a in AXES))
    moments = p.groupBy(*inner).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(a) for a in AXES)).alias("centre"), F.array(*(F.covar_samp(a, b) for a, b in pairs)).alias("moments"))

    @F.pandas_udf("array<double>")
    def axes_of(n: pd.Series, moments: pd.Series) -> pd.Series:
        out = []
        for count, m in zip(n, moments, strict=True):
            axes = np.eye(3)
            if count >= 3:
                cov = np.zeros((3, 3))
                cov[np.triu_indices(3)] = [float(x) for x in m]
                values, vectors = np.linalg.eigh(cov + np.triu(cov, 1).T)
                axes = vectors[:, np.argsort(values)[::-1]].T
            out.append(axes.ravel().tolist())
        return pd.Series(out)

    other = [f"_o{i}" for i in range(len(keys))]
    frames = materialise(moments.select(*(F.col(i).alias(o) for i, o in zip(inner, other, strict=True)), "centre", axes_of("n", "moments").alias("axes")), "axes")
    local = [sum((F.col("axes")[3 * k + j] * (F.col(a) - F.col("centre")[j]) for j, a in enumerate(AXES)), F.lit(0.0)) for k in range(3)]
    same = reduce(lambda x, y: x & y, (F.col(i).eqNullSafe(F.col(o)) for i, o in zip(inner, other, strict=True)), F.lit(True))
    spans = p.join(frames, same).groupBy(*inner).agg(F.array(*(F.max(c) - F.min(c) for c in local)).alias("size"))
    return spans.join(frames, same).select(*(F.col(i).alias(k) for i, k in zip(inner, keys, strict=True)), "centre", "size", "axes")


def object_counts(instances: DataFrame, image: str, name: str) -> DataFrame:
    """Map of class name to number of instances per image."""
    g = instances.groupBy(image, name).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return g.groupBy(image).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias("object_counts"))


def attach_boxes(instances3d: DataFrame, boxes2d: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Left join of 2-D boxes to instances; of several boxes of one instance the last counts."""
    last = boxes2d.groupBy(*keys).agg(F.max_by("bbox", order).alias("bbox"), F.max_by("score", order).alias("score"))
    return instances3d.join(last, list(keys), "left")


def complete_scenes(images: DataFrame, artifacts: Sequence[DataFrame], image: str = "image_id") -> DataFrame:
    """Images for which every artifact exists (a chain of semi joins)."""
    for a in artifacts:
        images = images.join(a.select(image).distinct(), image, "left_semi")
    return images


def package(images: DataFrame, counts: DataFrame, rooms: DataFrame, instances: DataFrame, image: str = "image_id", version: str = "1.0") -> DataFrame:
    """One nested document per image: counts, extents, boxes by class."""
    by = instances.groupBy(image, "class_name").agg(F.array_sort(F.collect_list(F.struct("instance_id", "num_points", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z"))).alias("b"))
    by = by.groupBy(image).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "b")))).alias("object_bboxes"))
    room = rooms.select(image, F.struct(*(c for c in rooms.columns if c != image)).alias("room"))
    return images.join(counts, image, "left").join(room, image, "left").join(by, image, "left").withColumn("schema_version", F.lit(version))
