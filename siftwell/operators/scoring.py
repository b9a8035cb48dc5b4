"""Rule-based scoring of model answers, as column expressions over (response, ground_truth, problem_type).

A score is a struct overall, format, accuracy: overall = (1 - w) * accuracy + w * format when the
format holds, else 0 (strict) or (1 - w) * accuracy (relaxed).  Task scorers read points, tracks
and boxes with from_json; failed parses score 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions import vector as V

#: Fixed thresholds of the task scorers.
TRACE = (50.0, 120.0)
TRACE_3D = (50.0, 130.0)
DEPTH = (0.1, 0.4)
POINT = (40.0, 150.0)
LENGTH_PENALTY, COUNT_PENALTY = 0.35, 0.3

POINTS = "array<struct<point_2d: array<double>, depth: double>>"
REGIONS = "array<struct<point_2d: array<double>, bbox_2d: array<double>, polygon: array<array<double>>>>"


def _parsed(text: Column, schema: str) -> Column:
    return F.coalesce(F.from_json(F.trim(T.clean_json(text)), schema), F.from_json(F.lit("[]"), schema))


def _points(items: Column) -> Column:
    return F.transform(F.filter(items, lambda x: x["point_2d"].isNotNull() & (F.size(x["point_2d"]) == 2)), lambda x: x["point_2d"])


def _root_mean_square(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda p, q: (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(squares))


def _depth_error(pa: Column, pt: Column) -> Column:
    """Mean absolute depth difference after resampling to the truth's length."""
    da, dt = (F.transform(p, lambda x: F.array(x["depth"], F.lit(0.0))) for p in (pa, pt))
    gaps = F.zip_with(V.resampled(da, F.size(dt)), dt, lambda x, y: F.abs(x[0] - y[0]))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps)


def _point(a: Column, regions: Column, t: Column) -> Column:
    polygons = F.transform(F.filter(regions, lambda r: r["polygon"].isNotNull() & (F.size(r["polygon"]) > 2)), lambda r: r["polygon"])
    found = F.filter(regions, lambda r: r["bbox_2d"].isNotNull() & (F.size(r["bbox_2d"]) == 4))
    share = lambda inside: F.size(F.filter(a, inside)) / F.size(a)
    in_any = share(lambda p: F.exists(polygons, lambda g: V.in_polygon(p, g)))
    box = F.get(found, F.lit(0))["bbox_2d"]
    near = V.ramp(V.nearest_mean(a, t), *POINT) - F.when(F.size(a) != F.size(t), COUNT_PENALTY).otherwise(0.0)
    return F.when(F.size(a) == 0, 0.0).when(F.size(polygons) > 0, in_any).when(F.size(found) > 0, share(lambda p: V.in_box(p, box))).otherwise(F.greatest(near, F.lit(0.0)))


def numeric_score(answer: Column, truth: Column) -> Column:
    """1 if both numbers agree after rounding to one decimal."""
    a, t = T.normalize_number(answer), T.normalize_number(truth)
    return F.coalesce((F.bround(a, 1) == F.bround(t, 1)).cast("double"), F.lit(0.0))


def choice_score(answer: Column, truth: Column) -> Column:
    return F.coalesce(T.same_choice(answer, truth).cast("double"), F.lit(0.0))


def exact_score(answer: Column, truth: Column) -> Column:
    return F.coalesce((F.lower(F.trim(answer)) == F.lower(F.trim(truth))).cast("double"), F.lit(0.0))


#: The kinds of problems that score_rows knows; any other scores 0.
TASKS = ("trace", "trace_3d", "point", "spatial grounding", "numerical", "regression", "multiple choice", "open-ended", "math")


def same_answers(df: DataFrame, truth: str, answer: str, out: str = "same") -> DataFrame:
    """Adds whether two mathematical answers are equivalent (functions.maths); each distinct pair is judged once.

    Rows with a null answer or truth count as not equivalent and are not shuffled to one place.
    """
    from siftwell.functions.maths import same_answer

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_judged=[same_answer(t, a) for t, a in zip(pdf["_truth"], pdf["_answer"], strict=True)])

    given = df.where(F.col(truth).isNotNull() & F.col(answer).isNotNull())
    pairs = given.select(F.col(truth).alias("_truth"), F.col(answer).alias("_answer")).distinct()
    judged = pairs.mapInPandas(judge, "_truth string, _answer string, _judged boolean")
    met = given.join(judged, (F.col(truth) == F.col("_truth")) & (F.col(answer) == F.col("_answer"))).withColumn(out, F.col("_judged")).drop("_truth", "_answer", "_judged")
    return met.unionByName(df.where(F.col(truth).isNull() | F.col(answer).isNull()).withColumn(out, F.lit(False)))


def score_rows(df: DataFrame, response: str, truth: str, kind: str, format_weight: float = 0.1, relaxed: bool = False, out: str = "score", kinds: tuple[str, ...] = TASKS) -> DataFrame:
    """Adds the score struct to every row, by the scorer of its kind (TASKS) on both sides' <answer> texts (whole texts without one).

    trace: ramp of the root mean square distance after resampling to the truth's length; another length costs a penalty.
    trace_3d: half that, half the ramp of the mean absolute depth error.  point: share inside any polygon, else inside the first
    box, else the nearest-distance ramp with a count penalty.  spatial grounding: overlap of the first boxes.  math: equivalence.

    kinds: those that may occur; without math, whose distinct pairs are judged apart, rows are never shuffled.

    Each parse is a column of its own: texts are parsed once, by the rows whose kind needs it, and expressions stay small.
    """
    k = F.lower(F.col(kind))
    places, tracks = k.isin("point", "trace", "trace_3d"), k.isin("trace", "trace_3d")
    steps: list[dict[str, Column]] = [
        {"_form": T.well_formed(F.col(response), k), "_a": F.when(T.has_answer(F.col(response)), T.extract_answer(F.col(response))).otherwise(F.col(response)), "_t": F.when(T.has_answer(F.col(truth)), T.extract_answer(F.col(truth))).otherwise(F.col(truth))},
        {
            "_pa": F.when(places, _parsed(F.col("_a"), POINTS)),
            "_pt": F.when(tracks, _parsed(F.col("_t"), POINTS)),
            "_ra": F.when(k == "spatial grounding", _parsed(F.col("_a"), REGIONS)),
            "_rt": F.when(k.isin("spatial grounding", "point"), _parsed(F.col("_t"), REGIONS)),
        },
        {"_xa": _points(F.col("_pa")), "_xt": _points(F.col("_pt")), "_xr": _points(F.col("_rt"))},
        {
            "_place": F.when(tracks & (F.size("_xa") > 1) & (F.size("_xt") > 1), _root_mean_square(V.resampled(F.col("_xa"), F.size("_xt")), F.col("_xt"))),
            "_miss": F.when(F.size("_xa") != F.size("_xt"), LENGTH_PENALTY).otherwise(0.0),
            "_depth": F.when((k == "trace_3d") & (F.size("_xa") > 1) & (F.size("_xt") > 1) & (F.size("_xa") == F.size("_pa")) & (F.size("_xt") == F.size("_pt")) & ~F.exists("_pa", lambda x: x["depth"].isNull()), _depth_error(F.col("_pa"), F.col("_pt"))),
        },
    ]
    df = df.withColumns(steps[0])
    if "math" not in kinds:
        df = df.withColumn("_same", F.lit(False))
    else:
        df = df.where((k != "math") | k.isNull()).withColumn("_same", F.lit(False)).unionByName(same_answers(df.where(k == "math"), "_t", "_a", "_same"))
    for step in steps[1:]:
        df = df.withColumns(step)
    zero = F.lit(0.0)
    right = (
        F.when(k == "trace", F.coalesce(F.greatest(V.ramp(F.col("_place"), *TRACE) - F.col("_miss"), zero), zero))
        .when(k == "trace_3d", F.coalesce(F.greatest(0.5 * V.ramp(F.col("_place"), *TRACE_3D) + 0.5 * V.ramp(F.col("_depth"), *DEPTH) - F.col("_miss"), zero), zero))
        .when(k == "point", _point(F.col("_xa"), F.col("_rt"), F.col("_xr")))
        .when(k == "spatial grounding", F.coalesce(V.iou(F.get("_ra", F.lit(0))["bbox_2d"], F.get("_rt", F.lit(0))["bbox_2d"]), zero))
        .when(k.isin("numerical", "regression"), numeric_score(F.col("_a"), F.col("_t")))
        .when(k == "multiple choice", choice_score(F.col("_a"), F.col("_t")))
        .when(k == "open-ended", exact_score(F.col("_a"), F.col("_t")))
        .when(k == "math", F.col("_same").cast("double"))
        .otherwise(zero)
    )
    # a null distance means that a track could not be read
    right = F.when(tracks & (F.col("_place").isNull() | ((k == "trace_3d") & F.col("_depth").isNull())), 0.0).otherwise(right)
    df = df.withColumn("_right", right)
    without = (1 - format_weight) * F.col("_right") if relaxed else zero
    overall = F.when(F.col("_form"), (1 - format_weight) * F.col("_right") + format_weight).otherwise(without)
    made = F.struct(overall.alias("overall"), F.col("_form").cast("double").alias("format"), (F.col("_right") if relaxed else F.when(F.col("_form"), F.col("_right")).otherwise(0.0)).alias("accuracy"))
    return df.withColumn(out, made).drop("_right", "_same", *(c for step in steps for c in step))


def mean_scores(df: DataFrame, columns: list[str], dataset: str) -> DataFrame:
    """Means over all rows and per dataset: two grouping sets in one pass."""
    g = df.rollup(dataset).agg(F.grouping(dataset).alias("_all"), *(F.avg(c).alias(c) for c in columns))
    return g.withColumn(dataset, F.when(F.col("_all") == 1, "all").otherwise(F.col(dataset))).drop("_all")


def score_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A user's batch scorer: fn takes a pandas batch and returns overall, format, accuracy for its rows."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = fn(pdf)[["overall", "format", "accuracy"]]
            yield pd.concat([pdf.reset_index(drop=True), made.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, f"{schema}, overall double, format double, accuracy double")
